"""Full-text retrieval: analyzer, postings, term statistics, BM25, reranking, fusion and quality measures."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.session import cut

# Budgets of the analyzer per field, BM25 constants and field weights, rerank weights.
BUDGETS = {"natural": (6144, 3072), "code": (2048, 1024), "capability": (192, 192)}
QUERY_TERMS, LONG_TERM = 192, 256
K1, B = 1.2, 0.75
WEIGHTS = {"natural": 8.0, "code": 4.0, "capability": 2.0}
RANK_WEIGHT, IDF_WEIGHT, EXACT_WEIGHT, RANK_SHIFT = 0.45, 0.40, 0.15, 60

_CJK = "぀-ヿ㐀-䶿一-鿿가-힣"
_RUN = re.compile(rf"[{_CJK}]+|[^\W_{_CJK}]+")
_CODE = re.compile(r"```.*?```|`[^`\n]+`", re.S)
_STRONG = re.compile(r"[A-Za-z_][\w]*(?:(?:::|[./\\#@:-])[\w]+)+|[a-z]+(?:[A-Z][a-z0-9]+)+|\w+_\w+")
_SPLIT = re.compile(r"[./\\_:#@-]+|(?<=[a-z0-9])(?=[A-Z])")


def _stored(term: str) -> str:
    """The term as it is kept: long ones hashed."""
    return term if len(term.encode()) <= LONG_TERM else "h:" + hashlib.sha256(term.encode()).hexdigest()


def _bounded(terms: list[str], field: str) -> list[str]:
    """Terms inside the field's budgets: head and tail of all terms, and of these the first distinct ones; long ones hashed."""
    total, distinct = BUDGETS[field]
    if len(terms) > total:
        half = total // 2
        terms = terms[: total - half] + terms[-half:]
    out, seen = [], set()
    for t in terms:
        t = _stored(t)
        if t in seen or len(seen) < distinct:
            seen.add(t)
            out.append(t)
    return out


def natural_terms(text: str) -> list[str]:
    """Words in lower case after NFKC; runs of CJK as 2- and 3-grams, a single sign as itself."""
    out = []
    for run in _RUN.findall(unicodedata.normalize("NFKC", text).lower()):
        if re.match(rf"[{_CJK}]", run):
            out += [run] if len(run) == 1 else [run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1)]
        else:
            out.append(run)
    return out


def code_terms(text: str) -> list[str]:
    """Identifiers in markdown code, and in prose those whose form gives them away: whole and in parts."""
    inside = _CODE.findall(text)
    found = [w for c in inside for w in re.findall(r"[A-Za-z_][\w./\\:#@-]*\w", c)] + _STRONG.findall(_CODE.sub(" ", text))
    out = []
    for w in found:
        parts = [p for p in _SPLIT.split(w) if p]
        out += [w.lower(), *(p.lower() for p in parts if len(parts) > 1)]
    return out


def _fields(text: str | None, capabilities: list[str] | None = None) -> dict[str, list[str]]:
    return {"natural": natural_terms(text or ""), "code": code_terms(text or ""), "capability": [c.lower() for c in capabilities or []]}


def analyze(text: str | None, capabilities: list[str] | None = None) -> list[tuple[str, str]]:
    """(field, term) of a document inside the budgets. Null has none."""
    return [(f, t) for f, terms in _fields(text, capabilities).items() for t in _bounded(terms, f)]


def all_terms(text: str | None) -> list[tuple[str, str]]:
    """(field, term) of a document, however long it is. Null has none."""
    return [(f, _stored(t)) for f, terms in _fields(text).items() for t in terms]


def query_terms(text: str) -> list[tuple[str, str]]:
    """Distinct (field, term) of a query; ValueError if it has fewer than two searchable characters."""
    if sum(c.isalnum() for c in text) < 2:
        raise ValueError("query too broad")
    terms = list(dict.fromkeys(all_terms(text)))[:QUERY_TERMS]
    return list(dict.fromkeys([*terms, *(("capability", t) for _, t in terms)]))


def postings(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, field, term, tf) of all terms by the full analyzer, in Arrow batches. Rows without id are out; null and empty texts have no postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, fields, terms, tfs = [], [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts: dict[tuple[str, str], int] = {}
                for ft in all_terms(t):
                    counts[ft] = counts.get(ft, 0) + 1
                for (f, term), n in counts.items():
                    docs.append(d)
                    fields.append(f)
                    terms.append(term)
                    tfs.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(fields, pa.string()), pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], names=[doc, "field", "term", "tf"])

    rows = documents.where(F.col(doc).isNotNull()).select(doc, text)
    return rows.mapInArrow(run, f"{doc} {rows.schema[doc].dataType.simpleString()}, field string, term string, tf bigint")


def matches(documents: DataFrame, doc: str, text: str, terms: list[tuple[str, str]]) -> DataFrame:
    """(doc, length, hits) of every document that has terms: their number over all fields, and (field, term, tf) of those of the (field, term) asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = set(terms)
        for batch in batches:
            docs, lengths, hits = [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = all_terms(t)
                if own:
                    counts: dict[tuple[str, str], int] = {}
                    for ft in own:
                        if ft in wanted:
                            counts[ft] = counts.get(ft, 0) + 1
                    docs.append(d)
                    lengths.append(len(own))
                    hits.append([{"field": f, "term": term, "tf": n} for (f, term), n in counts.items()])
            kind = pa.list_(pa.struct([("field", pa.string()), ("term", pa.string()), ("tf", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(lengths, pa.int64()), pa.array(hits, kind)], names=[doc, "length", "hits"])

    rows = documents.where(F.col(doc).isNotNull()).select(doc, text)
    return rows.mapInArrow(run, f"{doc} {rows.schema[doc].dataType.simpleString()}, length bigint, hits array<struct<field: string, term: string, tf: bigint>>")


def ascii_postings(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, term, tf) of the words [a-z0-9]+ of a text: all in the JVM."""
    words = documents.where(F.col(doc).isNotNull()).select(doc, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)).alias("term"))
    return words.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def ascii_hits(documents: DataFrame, doc: str, text: str, terms: list[str]) -> DataFrame:
    """(doc, term, tf, length) of the documents that have any of the terms, in one pass: words are filtered before they are exploded. length is in all words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    held = documents.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(doc, words.alias("_words"))
    hits = held.select(doc, F.size("_words").cast("bigint").alias("length"), F.explode(F.filter("_words", lambda w: w.isin(terms))).alias("term"))
    return hits.groupBy(doc, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def ascii_lengths(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, length) in words [a-z0-9]+, of documents that have any; without making postings."""
    n = F.size(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))
    return documents.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(doc, n.alias("_n")).groupBy(doc).agg(F.sum("_n").alias("length")).where("length > 0")


def document_frequency(post: DataFrame) -> DataFrame:
    """df per term (and field, if there is one); postings have one row per document and term, so counting rows is exact."""
    keys = [c for c in ("field", "term") if c in post.columns]
    return post.groupBy(*keys).agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def selected_terms(frequencies: list[tuple[str, str, int]], n: int, most: int = 32) -> list[tuple[str, str, int]]:
    """Query terms worth searching, from (field, term, df) of the query's own terms: without df 0, without natural and code terms in over a fifth
    of all documents (if that takes all, the two rarest stay), by df, field and order, at most `most`."""
    seen = [f for f in frequencies if f[2] > 0]
    good = [f for f in seen if f[0] == "capability" or f[2] * 5 <= n] or sorted(seen, key=lambda f: f[2])[:2]
    rank = {"code": 0, "natural": 1, "capability": 2}
    order = {f: i for i, f in enumerate(frequencies)}
    return sorted(good, key=lambda f: (f[2], rank.get(f[0], 3), order[f]))[:most]


def _of_terms(post: DataFrame, terms: list) -> tuple[DataFrame, list[str]]:
    """The postings of the terms, and their key columns: the terms are (field, term) where the postings have fields."""
    if "field" not in post.columns:
        return post.where(F.col("term").isin(terms)), ["term"]
    return post.where(F.concat_ws(" ", "field", "term").isin([f"{f} {t}" for f, t in terms])), ["field", "term"]


def bm25(post: DataFrame, terms: list, doc: str, top: int = 300, lengths: DataFrame | None = None) -> DataFrame:
    """(doc, score_ppm, rank) of the best documents for OR-ed terms; ties by document. Only postings of the terms and one length a document are read.

    Postings with fields: terms are (field, term), the frequency counts WEIGHTS times and the length is that of all fields.
    lengths: (doc, length), where they are known more cheaply than by adding up all postings."""
    lengths = post.groupBy(doc).agg(F.sum("tf").alias("_len")) if lengths is None else lengths.select(doc, F.col("length").alias("_len"))
    n, mean = lengths.agg(F.count(F.lit(1)), F.avg("_len")).first()
    hits, keys = _of_terms(post, terms)
    df = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_df"))  # at most one row a query term
    scored = hits.join(F.broadcast(df), keys).join(lengths, doc)
    tf = F.col("tf")
    if "field" in keys:
        tf = tf * F.element_at(F.create_map(*(F.lit(x) for w in WEIGHTS.items() for x in w)), F.col("field"))
    weight = F.log(1 + (F.lit(n) - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    part = weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.lit(mean or 1.0)))
    ppm = F.round(F.sum(part) * 1_000_000).cast("bigint")
    best = scored.groupBy(doc).agg(ppm.alias("score_ppm")).orderBy(F.desc("score_ppm"), doc).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score_ppm"), doc)))  # over at most `top` rows


def rerank(ranked: DataFrame, post: DataFrame, documents: DataFrame, doc: str, text: str, terms: list, phrase: str, top: int = 200) -> DataFrame:
    """(doc, relevance_ppm): rank, share of idf matched and whether the phrase occurs, for the first `top` of a ranking. Terms as in bm25."""
    n = documents.where(F.col(doc).isNotNull()).count()
    hits, keys = _of_terms(post, terms)
    df = hits.groupBy(*keys).agg(idf(F.lit(n), F.count(F.lit(1))).alias("_idf"))
    total = df.agg(F.sum("_idf")).first()[0] or 1.0
    first = F.broadcast(ranked.where(F.col("rank") <= top))  # at most `top` rows
    matched = hits.join(first, doc).join(F.broadcast(df), keys).groupBy(doc).agg(F.sum("_idf").alias("_matched"))
    exact = documents.select(doc, F.contains(F.lower(text), F.lit(phrase.lower())).cast("int").alias("_exact")).join(first, doc)
    score = RANK_WEIGHT * (RANK_SHIFT + 1) / (RANK_SHIFT + F.col("rank")) + IDF_WEIGHT * F.col("_matched") / F.lit(total) + EXACT_WEIGHT * F.col("_exact")
    return exact.join(matched, doc).select(doc, F.round(score * 1_000_000).cast("bigint").alias("relevance_ppm")).orderBy(F.desc("relevance_ppm"), doc)


def fielded_search(documents: DataFrame, doc: str, text: str, query: str, phrase: str) -> DataFrame:
    """(doc, relevance_ppm) of the best documents for a query over all fields of the full analyzer. One pass of the analyzer over the texts."""
    asked = query_terms(query)
    found = cut(matches(documents, doc, text, asked))
    post = found.select(doc, F.inline("hits"))
    df = {(r["field"], r["term"]): r["df"] for r in document_frequency(post).collect()}  # at most one row a query term
    terms = [(f, t) for f, t, _ in selected_terms([(f, t, df.get((f, t), 0)) for f, t in asked], documents.where(F.col(doc).isNotNull()).count())]
    return rerank(bm25(post, terms, doc, lengths=found), post, documents, doc, text, terms, phrase)


#: The fields of a turn and the terms in each, as patterns of ASCII text in lower case: words, and names with inner dots, slashes or dashes.
FIELD_PATTERNS = {"natural": "[a-z0-9]+", "code": "[a-z0-9]+(?:[/._-][a-z0-9]+)+"}


def ascii_query(text: str) -> list[tuple[str, str]]:
    """(field, term) of a query, in order and without repeats; every term may also be a capability's name. ValueError if fewer than two characters can be searched."""
    if sum(c.isalnum() for c in text) < 2:
        raise ValueError("query too broad")
    held = [(f, t) for f, p in FIELD_PATTERNS.items() for t in re.findall(p, text.lower())]
    return list(dict.fromkeys([*held, *(("capability", t) for _, t in held)]))[: 2 * QUERY_TERMS]


def turn_hits(turns: DataFrame, names: DataFrame, asked: list[tuple[str, str]], phrase: str) -> DataFrame:
    """(turnKey, observedAt, length, exact, hits) of every turn that has terms: one pass, which keeps of all terms only their number and those asked for.

    turns: turnKey, observedAt, problem; names: (turnKey, capabilityName), each a term of the turn. Null and empty problems have no terms."""
    named = names.where("turnKey is not null and capabilityName is not null").select("turnKey", F.lower("capabilityName").alias("name")).groupBy("turnKey").agg(F.collect_set("name").alias("capability"))
    rows = turns.select("turnKey", "observedAt", F.lower(F.coalesce("problem", F.lit(""))).alias("low"), "problem").join(named, "turnKey", "left")
    none = F.array().cast("array<string>")
    terms = {f: F.regexp_extract_all("low", F.lit(p), 0) for f, p in FIELD_PATTERNS.items()} | {"capability": F.coalesce("capability", none)}
    rows = rows.select("turnKey", "observedAt", F.contains("low", F.lit(phrase.lower())).cast("int").alias("exact"), *(c.alias(f) for f, c in terms.items()))
    wanted = {f: [t for g, t in asked if g == f] for f in terms}

    def hits(f: str) -> Column:
        held = F.filter(f, lambda t: t.isin(wanted[f])) if wanted[f] else none
        return F.transform(F.array_distinct(held), lambda t: F.struct(F.lit(f).alias("field"), t.alias("term"), F.size(F.filter(held, lambda x: x == t)).cast("bigint").alias("tf")))

    size = sum((F.size(f) for f in terms), F.lit(0)).cast("bigint")
    return rows.select("turnKey", "observedAt", size.alias("length"), "exact", F.concat(*(hits(f) for f in terms)).alias("hits")).where("length > 0")


def search_turns(turns: DataFrame, names: DataFrame, query: str, phrase: str | None = None, candidates: int = 300, results: int = 200) -> DataFrame:
    """(turnKey, observedAt, relevance_ppm, position) of the best turns for a query.

    Terms are chosen by how rare they are, BM25 with field weights gives the candidates, and these are ordered by their rank, the share of idf they match and
    whether the phrase (the query itself by default) occurs as it is; newest first among equals, then by key. The corpus is read once."""
    asked = ascii_query(query)
    found = cut(turn_hits(turns, names, asked, phrase or query))
    n, mean = found.agg(F.count(F.lit(1)), F.avg("length")).first()
    post = found.select("turnKey", "length", F.inline("hits"))
    df = {(r["field"], r["term"]): r["df"] for r in post.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).collect()}  # at most one row a query term
    chosen = selected_terms([(f, t, df.get((f, t), 0)) for f, t in asked], n)
    if not chosen:
        return found.limit(0).select("turnKey", "observedAt", F.lit(0).cast("bigint").alias("relevance_ppm"), F.lit(0).cast("bigint").alias("position"))
    stats = [(f, t, WEIGHTS[f], math.log(1 + (n - k + 0.5) / (k + 0.5)), math.log((n + 1) / (k + 1)) + 1) for f, t, k in chosen]
    table = F.broadcast(turns.sparkSession.createDataFrame(stats, "field string, term string, w double, bm double, idf double"))  # at most 32 rows
    tf = F.col("tf") * F.col("w")
    part = F.col("bm") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0)))
    best = post.join(table, ["field", "term"]).groupBy("turnKey").agg(F.round(F.sum(part) * 1_000_000).cast("bigint").alias("score"), F.sum("idf").alias("matched")).orderBy(F.desc("score"), "turnKey").limit(candidates)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "turnKey"))).where(F.col("rank") <= results)  # over at most `candidates` rows
    total = sum(x[-1] for x in stats)
    relevance = RANK_WEIGHT * (RANK_SHIFT + 1) / (RANK_SHIFT + F.col("rank")) + IDF_WEIGHT * F.col("matched") / F.lit(total) + EXACT_WEIGHT * F.col("exact")
    out = found.select("turnKey", "observedAt", "exact").join(F.broadcast(ranked), "turnKey").select("turnKey", "observedAt", F.round(relevance * 1_000_000).cast("bigint").alias("relevance_ppm"))
    line = Window.orderBy(F.desc("relevance_ppm"), F.col("observedAt").desc_nulls_last(), "turnKey")  # over at most `results` rows
    return out.withColumn("position", F.row_number().over(line).cast("bigint"))


def memory_search(entries: DataFrame, doc: str, text: str, query: str, k: int) -> DataFrame:
    """(doc, score_ppm, rank): the best k entries for the first 32 different words of a query, any of them, by BM25; ties by id."""
    terms = list(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))[:32]
    hits = cut(ascii_hits(entries, doc, text, terms))
    return bm25(hits.select(doc, "term", "tf"), terms, doc, k, lengths=ascii_lengths(entries, doc, text))


def recall(lists: list[tuple[str, DataFrame]], doc: str, k: int) -> DataFrame:
    """(doc, list, rank, position): ranked lists as one, by rank and then by the order of the lists and id; a document in several lists stands where it is first.

    For lists without common documents that is reciprocal rank fusion. Lists are cut to 3 k before."""
    rows = None
    for no, (name, ranked) in enumerate(lists):
        part = ranked.where(F.col("rank") <= 3 * k).select(doc, F.lit(name).alias("list"), F.lit(no).alias("_no"), F.col("rank").cast("bigint").alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    one = rows.groupBy(doc).agg(F.min(F.struct("rank", "_no", "list")).alias("_f")).select(doc, F.col("_f.list").alias("list"), F.col("_f._no").alias("_no"), F.col("_f.rank").alias("rank"))
    line = ["rank", "_no", doc]
    return one.orderBy(*line).limit(k).withColumn("position", F.row_number().over(Window.orderBy(*line)).cast("bigint")).drop("_no")  # over k rows


def head_tail(fields: dict[str, Column], head: int, tail: int) -> Column:
    """array<struct<place, field, item>>: of arrays side by side the first `head` items, one from each field in turn, and of the rest the last `tail`, in turn from their ends.

    All items if there are no more than head + tail. Items keep their place in their field, from 1; null fields have none."""
    names = list(fields)

    def placed(no: int, c: Column) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, i: F.struct((i + 1).alias("place"), F.lit(no).alias("no"), (F.size(c) - i).alias("from_end"), x.alias("item")))

    rows = F.concat(*(placed(n, c) for n, c in enumerate(fields.values())))
    front = F.array_sort(rows)
    rest = F.array_sort(F.transform(F.slice(front, F.lit(head + 1), F.greatest(F.size(front) - head, F.lit(0))), lambda x: F.struct(x["from_end"].alias("from_end"), x["no"].alias("no"), x["place"].alias("place"), x["item"].alias("item"))))
    name = F.array(*map(F.lit, names))
    pick = lambda x: F.struct(x["place"].alias("place"), F.element_at(name, x["no"] + 1).alias("field"), x["item"].alias("item"))
    return F.concat(F.transform(F.slice(front, 1, head), pick), F.transform(F.slice(rest, 1, tail), pick))


def fuse(lists: list[DataFrame], doc: str, k: int = RANK_SHIFT) -> DataFrame:
    """Reciprocal rank fusion of (doc, rank) lists: (doc, rrf_ppm), best first."""
    rows = lists[0].select(doc, "rank")
    for more in lists[1:]:
        rows = rows.unionByName(more.select(doc, "rank"))
    return rows.groupBy(doc).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))) * 1_000_000).cast("bigint").alias("rrf_ppm")).orderBy(F.desc("rrf_ppm"), doc)


def quality(ranked: DataFrame, query: str, rank: str, grade: str, at: int = 10, recall_at: int = 300) -> DataFrame:
    """(query, ndcg_ppm, recall_ppm) from graded rankings: one row per query and document, rank null if it wasn't found."""
    ideal_line = Window.partitionBy(query).orderBy(F.desc(grade))
    rows = ranked.withColumn("_ideal", F.row_number().over(ideal_line))
    gain = lambda place: (F.pow(F.lit(2.0), F.col(grade)) - 1) / F.log2(place + 1)
    agg = rows.groupBy(query).agg(
        F.sum(F.when(F.col(rank) <= at, gain(F.col(rank)))).alias("_dcg"), F.sum(F.when(F.col("_ideal") <= at, gain(F.col("_ideal")))).alias("_best"),
        F.count_if((F.col(rank) <= recall_at) & (F.col(grade) > 0)).alias("_got"), F.count_if(F.col(grade) > 0).alias("_all"),
    )
    ppm = lambda a, b: F.when(b > 0, F.round(F.coalesce(a, F.lit(0)) / b * 1_000_000)).cast("bigint")
    return agg.select(query, ppm(F.col("_dcg"), F.col("_best")).alias("ndcg_ppm"), ppm(F.col("_got"), F.col("_all")).alias("recall_ppm"))
