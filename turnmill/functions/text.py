"""Scalar text functions as Column expressions. Only Unicode normalization, keyed digests and canonical JSON need Python, in Arrow batches."""

from __future__ import annotations

import hashlib
import hmac
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- error signatures

# What an error signature sets aside, in this order, in text that is in lower case.
SIGNATURE = [
    (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
    (r"\b0x[0-9a-f]+\b", "<hex>"),
    (r"([a-z]:[\\/]|/)([^\s:'\"`]+[\\/])*[^\s:'\"`]*", "<path>"),
    (r"\b[0-9]+\b", "<number>"),
    (r"\s+", " "),
]


def error_signature(text: Column) -> Column:
    """A digest of an error message that is the same for messages that differ only in ids, hex numbers, absolute paths, numbers and white space. Text should be in NFC, see nfc()."""
    t = F.lower(text)
    for pattern, mark in SIGNATURE:
        t = F.regexp_replace(t, pattern, mark)
    return F.sha2(F.encode(F.trim(t), "utf-8"), 256)


# ---- Unicode


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition. Text that is ASCII passes unchanged; null stays null."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility composition in lower case, for exact comparison of user text."""
    return text.map(lambda t: t if t is None else t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).lower())


def well_formed(raw: Column) -> Column:
    """Text from UTF-8 bytes of doubtful origin: what is no character, lone surrogates too, becomes U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def utf8_prefix(text: Column, most: int = 512) -> Column:
    """The longest beginning of at most `most` bytes that cuts no character. Characters have 1 to 4 bytes, so only the last few of the candidates are tried."""
    head = F.substring(text, 1, most)
    size = F.octet_length(head)
    # as long as it has too many bytes: drop as many characters as the surplus surely has
    step = lambda t: F.when(F.octet_length(t) > most, F.left(t, F.greatest(F.lit(0), F.length(t) - F.greatest(F.lit(1), F.ceil((F.octet_length(t) - most) / 4)).cast("int")))).otherwise(t)
    rounds = F.sequence(F.lit(1), F.lit(most.bit_length() * 3 + 4))
    return F.when(size <= most, head).otherwise(F.aggregate(rounds, head, lambda t, _: step(t)))


# ---- keys


def _framed(domain: str, parts: tuple[Column, ...]) -> Column:
    framed = [F.encode(F.lit(domain + "\0"), "utf-8")]
    for p in parts:
        raw = F.encode(p, "utf-8")
        framed += [F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("bigint")), 8, "0")), raw]
    return F.concat(*framed)


def stable_key(domain: str, *parts: Column) -> Column:
    """A key from a domain tag and parts, each with its length before it, so that no two part lists collide."""
    return F.sha2(_framed(domain, parts), 256)


def keyed_fingerprint(secret: bytes, domain: str, *parts: Column) -> Column:
    """HMAC-SHA-256 of the framed parts as hex: equal inputs can be told without the inputs being guessable. All of it stays in the JVM."""
    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    pad = lambda byte: F.unhex(F.lit(bytes(a ^ byte for a in key.ljust(64, b"\0")).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), _framed(domain, parts)), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def keyed_digest(secret: bytes, raw: bytes) -> str:
    """The same of bytes on the driver."""
    return hmac.new(secret, raw, hashlib.sha256).hexdigest()


# ---- JSON and times


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys and without blanks; null for null and for what is no JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one)


def canonical_time(at: Column) -> Column:
    """A timestamp as RFC 3339 text in UTC with milliseconds."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def parsed_time(text: Column) -> Column:
    """Microseconds of an RFC 3339 text with offset; null for anything else, days that no calendar has included."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"), F.unix_micros(F.try_to_timestamp(text)))


# ---- credentials

# Public forms of credentials, by what lint calls them, with what stands in their place.
SECRETS = {
    "private-key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[PRIVATE KEY]"),
    "api-key": (r"\bsk-[A-Za-z0-9_-]{20,}", "[API KEY]"),
    "github-token": (r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}\b", "[GITHUB TOKEN]"),
    "github-fine-grained-token": (r"\bgithub_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}\b", "[GITHUB TOKEN]"),
    "aws-access-key": (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "[AWS KEY]"),
    "slack-token": (r"\b(?:xoxb|xoxp|xoxe|xapp)-[A-Za-z0-9-]{10,}", "[SLACK TOKEN]"),
    "google-api-key": (r"\bAIza[A-Za-z0-9_-]{35}", "[GOOGLE KEY]"),
    "jwt": (r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[JWT]"),
    "url-password": (r"://[A-Za-z0-9._~%+-]+:[^\s/@]+@", "://[CREDENTIALS]@"),
}
#: Fields of JSON objects and names of assignments whose values are secret.
SECRET_NAMES = ["password", "passwd", "passphrase", "secret", "client_secret", "api_key", "apikey", "access_token", "refresh_token", "private_key", "authorization"]
_NAMES = "|".join(SECRET_NAMES)
JSON_FIELD = rf'(?i)("(?:{_NAMES})"\s*:\s*)"(?:[^"\\]|\\.)+"'
ASSIGNMENT = rf"(?i)\b((?:{_NAMES})\s*=\s*)[^\s\"',;&]+"
BEARER, BASIC = r"(?i)\bbearer\s+([A-Za-z0-9._~+/-]{16,}=*)", r"(?i)\bbasic\s+([A-Za-z0-9+/]{8,}={0,2})"
WORD, LONG_HEX, ENTROPY = r"[A-Za-z0-9+/_=-]{20,}", r"\b[0-9a-fA-F]{32,}\b", 4.0


def _bearer(text: Column) -> Column:
    """Bearer tokens of a text: prose behind the word has no digit."""
    return F.filter(F.regexp_extract_all(text, F.lit(BEARER), 1), lambda t: t.rlike("[0-9]"))


def _basic(text: Column) -> Column:
    """Credentials behind the word basic: only what decodes to printable text with a colon in it, so prose stays."""
    return F.filter(F.regexp_extract_all(text, F.lit(BASIC), 1), lambda t: F.coalesce(F.try_to_binary(t, F.lit("base64")).cast("string").rlike(r"^[\x20-\x7E]*:[\x20-\x7E]*$"), F.lit(False)))


def redact(text: Column) -> Column:
    """The text without credentials. All of it stays in the JVM; null stays null."""
    for pattern, mark in SECRETS.values():
        text = F.regexp_replace(text, pattern, mark.replace("$", r"\$"))
    for found in (_bearer(text), _basic(text)):
        text = F.aggregate(F.array_distinct(found), text, lambda t, token: F.replace(t, token, F.lit("[REDACTED]")))
    return F.regexp_replace(F.regexp_replace(text, JSON_FIELD, '$1"[REDACTED]"'), ASSIGNMENT, "$1[REDACTED]")


def _spans(text: Column, code: str, pattern: str) -> Column:
    """array<struct<code, start_at, size>> of all matches; start_at counts from 1. The gaps between matches give the places."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    total = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda x, t: x + F.length(t))
    at = lambda i: total(gaps, i + 1) + total(found, i) + 1
    return F.transform(found, lambda t, i: F.struct(F.lit(code).alias("code"), at(i).cast("bigint").alias("start_at"), F.length(t).cast("bigint").alias("size"), t.alias("_text")))


def findings(text: Column) -> Column:
    """array<struct<code, start_at, size>>: what looks like a credential, by known form, as a long hex word, or as a long word of high entropy. Null has null."""
    parts = [_spans(text, code, pattern) for code, (pattern, _) in SECRETS.items()]
    parts += [F.filter(_spans(text, "high-entropy", WORD), lambda s: entropy(s["_text"]) >= ENTROPY), _spans(text, "long-hex", LONG_HEX), _spans(text, "secret-field", JSON_FIELD), _spans(text, "secret-assignment", ASSIGNMENT)]
    return F.transform(F.concat(*parts), lambda s: F.struct(s["code"].alias("code"), s["start_at"].alias("start_at"), s["size"].alias("size")))


def entropy(word: Column) -> Column:
    """Shannon entropy of a word's characters, in bits."""
    chars = F.split(word, "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def preview(text: Column, size: int = 160) -> Column:
    """One line of at most `size` code points: credentials and controls out, white space collapsed."""
    plain = F.regexp_replace(redact(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.substring(F.trim(F.regexp_replace(plain, r"\s+", " ")), 1, size)


# ---- paths


def normalize_path(path: Column) -> Column:
    """A path in lexical normal form: one kind of slash, without blanks parts, . and what .. takes back. Null stays null.

    A drive letter is in upper case; of a network path (two slashes or backslashes first) host and share can't be taken back; .. above the root
    of an absolute path goes nowhere, above a relative one it stays. An empty path is a dot."""
    unc = path.startswith("\\\\") | path.startswith("//")
    drive = path.rlike(r"^[A-Za-z]:")
    portable = F.when(unc | drive, F.replace(path, F.lit("\\"), F.lit("/"))).otherwise(path)
    rest = F.when(drive, F.substring(portable, F.lit(3), F.length(portable))).otherwise(portable)
    absolute = unc | rest.startswith("/")
    keep = F.when(unc, 2).otherwise(0)
    none = F.array().cast("array<string>")

    def take(out: Column, part: Column) -> Column:
        can = (F.size(out) > keep) & F.coalesce(F.try_element_at(out, F.lit(-1)) != "..", F.lit(False))
        return F.when(part.isin("", "."), out).when((part == "..") & can, F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when((part == "..") & absolute, out).otherwise(F.concat(out, F.array(part)))

    body = F.array_join(F.aggregate(F.split(rest, "/"), none, take), "/")
    head = F.when(drive, F.concat(F.upper(F.substring(path, 1, 1)), F.lit(":"))).otherwise(F.lit(""))
    whole = F.concat(head, F.when(unc, "//").when(absolute, "/").otherwise(""), body)
    return F.when(path.isNull(), None).when(whole == "", ".").otherwise(whole)


def relative_path(path: Column, root: Column) -> Column:
    """A normalized path seen from a normalized root: relative where it lies in it, a relative one as it is, else null."""
    base = F.regexp_replace(root, "/+$", "")
    absolute = path.rlike(r"^([A-Za-z]:/|/)")
    return F.when(~absolute, path).when(path == root, ".").when(path.startswith(F.concat(base, F.lit("/"))), F.substring(path, F.length(base) + 2, F.length(path)))
