"""The labelled table that the tagger for personal information is trained on.

Rows are (text, spans); a span is (start, end, kind). Texts are put together from written patterns with invented
people and places, so the table is small, free of real data and the same for a given seed. `{name}`, `{email}`,
`{phone}`, `{id}` and `{addr}` are items; the other slots are ordinary words, numbers and look-alikes.
"""

from __future__ import annotations

import random
import re
import unicodedata
import uuid

KINDS = ("email", "phone", "id_number", "address", "name")

# The material of the table.
_GIVEN = "Alma Boris Carla Derek Emilia Farid Gita Henrik Ines Jorge Kira Luis Mina Nils Oda Petra Quentin Rosa Stefan Tessa Umar Vera Walter Xavier Yara Zeno André Chloé Søren Núria Ömer Faith Grace Chase Rob Bill Dawn Rich".split()
_FAMILY = "Abelmoor Brackwith Cravenholt Dunmarrow Esterling Farrowgate Gildersten Hartquell Ivesdale Karrowin Lockmere Marchwell Norvath Ostrander Pellwick Quarrendon Rustvale Stavenhagen Tormund Ulverton Varnholt Wintersby Yelland Zorbeck MacAllen O'Brannon D'Arvel Kerr-Holt van Drees de Mornay Ångvik Müllenhardt".replace("van Drees", "van_Drees").replace("de Mornay", "de_Mornay").split()
_HOSTS = "example.org orvane.test lumber.example quarr.invalid sellan.test venn.example mail.example.com corp.orvane.test post.lumber.example lists.venn.invalid team.quarr.test drevik.example hub.sellan.invalid".split()
_STREETS = "Harrow Mill|Quartz Hollow|Elder Bend|Pine Ridge|Maple|Old Tannery|North Ferry|Miller's Gate|Copper Beech|Sandpiper|Birch Quay|Larkspur|West Orchard|King's Landing|Gravel Hill|Cedar|Ashby|Thornbury Rise|Cobbler's End|Fernway".split("|")
_SUFFIX = "Street St. Road Rd Lane Ave Avenue Drive Way Court Ln Blvd St Rd. Terrace Close".split()
_TOWNS = "Altmoor|Brackley Cross|Dornfeld|Westharbour|Kaltenau|Pinnford|Oststadt|Larch Sands|Mühlen|Kornhafen".split("|")
_DE_STEM = "Birken Linden Sonnen Kirsch Schmiede Brunnen Wiesen Hasel Tannen Kloster Markt Fischer Weiden Falken Erlen Gärtner Stein Hof".split()
_DE_END = "straße weg gasse allee platz kamp grund bogen ring ufer steig hof wall pfad damm rain berg stieg".split()
_DE_FRONT = "Am|Zum|An der|Im|Zur|Auf dem|Unter den".split("|")
_DE_NOUN = "Mühlbach Rosenhang Eichwald Steinbruch Wehr Anger Kornfeld Weiher Rehsprung Lindenplatz Torweg Hafenbecken".split()
_NOUNS = "queue worker cache index parser scheduler snapshot cursor lease table token frame batch log panel build mirror trigger ledger shard chunk scanner codec step".split()
_ADJ = "stale late empty partial renamed orphaned shadowed unread broken duplicate ambiguous oversized sealed".split()
_VERBS = "rebuilt skipped flagged cached rejected moved sealed compared kept merged trimmed replayed dropped".split()
_FILES = "src/io/pages.rs lib/walk.py docs/guide.md config/keys.toml tests/merge_test.py tools/clean.sh crates/core/disk.rs src/view/pane.tsx".split()
_TITLE = "Lane Worker Gate Index Access Complete Retry Harbor Valley Loop Main Block Runner Scheduler Release Notes Queue Mirror Build Permission Restart Read Failed Pending Done Review Station Bridge Point Start Ready Bay".split()
_FILLER = [
    "The {noun} {verb} the {adj} {noun} during the nightly run.", "Two of the {n} rows came from the {noun}, the rest after the rename.", "{file}:{n}: {adj} {noun}",
    '{{"rows":{n},"state":"{adj}","note":"while the {noun} was idle"}}', "We saw {n} files with a {adj} {noun} between two restarts.", "It took {n} tries until the {noun} {verb} it, so the count was off by one.",
    "Only {n} pages were left when the {noun} {verb} the {adj} {noun}.", "There is no {noun} in {file} for the {adj} case.", "My first guess was wrong: the {noun} never {verb} the {noun}.",
    "In {file}, the {noun} {verb} the {noun} on the first cold open.", "Error: {adj} {noun} in {file}", "TimeoutError: {adj} {noun} in {file}", "exit {d}: {adj} {noun} in {file}", "Refused: {adj} {noun} in {file}",
    "run_job build {file} --{adj} {n}", "probe {noun} limit {n}", 'rg -n "{noun}" {file}', "git show HEAD~{d} -- {file}", "open {file} --{adj} {n} --since 2025-0{d}-1{d}T0{d}:12:3{d}Z", "--parent-pid {n}{d}{d} # attempt {d}", "--stamp=17{d}{d}{d}0{d}1{d}3{d}9{d}",
    '{{"path":"{file}","lines":"{d}01-{d}99"}}', "*** update {file}\n- drop the {adj} {noun}\n+ check the {noun}", "Next time, check the {noun} first and leave {file} alone.", "Does anyone on the {noun} team remember why the {noun} {verb} it?",
    "Die Ablage prüfte den alten Eintrag nach dem Neustart.", "请先检查索引器，再处理两个重复的记录。", "El panel guardó la huella anterior durante la carga.", "If the {noun} is {adj}, drop it; otherwise check the {noun}.", "tests passed in {n} ms", "{file} <<NOTE\nkeep the {noun}, so the older rows stayed\nNOTE",
]
_DECOYS = [
    "installed @tools/{noun}-kit@{d}.{d}.1{d} and {noun}-reader@0.{d}{d}.1", "decorated with @cached and @{adj}", "user@{d}{d} joined {noun}", "origin git@git.venn.example:core/{noun}-{d}.git", "cloned ssh://git@host.venn.example/{noun}/{noun}.git", "remote deploy@build.orvane.test:repos/{noun}.git",
    "at 10.4{d}.0.{d}{d}:70{d}{d}", "rule {d}.{d}{d}.12 / {ddd}.{d}.{ddd}", "build 2025{d}{d}14-{dd}-{ddd} took {ddd}.{ddd} ms", "ticket QX-{dd}-{ddd} closed", "revision P{dd}Q{ddd}Z pinned", "revision QQ{dd}W{dd}X pinned", "bytes {ddd}-{dddd}-{dddd} of 9000000", "offset 00{dddd}{dddd}{dd}", "epoch 1{dddd}{dddd}{dddd}",
    "sha {dddd}-{dd}-{dd}f", "sha 9{d}a{dddd}b{dddd}c{dd}", "trace 3f2a{dddd}-{dd}aa-4b{dd}-9c{dd}-00{dddd}{dddd}ab", "{Title} {Title} restarted", "{Town} {Title} {Title} restarted", "{Word} {Title} build {dd} is green", "{Word} {Title} to the {noun} first", "{Word} {Title} was pressed twice", "{Word} {Title} after {dd} s",
    "{dd} {Title} loop ticks, line {ddd} {Title}", "see {Street} release notes", "see {Street} for the old rules", "order {dddd}-{ddd} of {ddd}", "port {dddd}, line {ddd}-{ddd}", "version {d}.{dd}.{ddd} of {Title}", "{ddd} {Title} {noun}s in lane {d}", "window {ddd}.{ddd} to {ddd}.{ddd}", "job {ddd}-{dd}-{ddd} was {adj}",
    "seq {dddd} {dd} {dddd} done", "range {ddd}/{dddd}-{ddd}", "id {ddd} of {noun}", "{Word} and {Word} are flags", "key {dddd}{dddd}{dddd}{dddd}", "{Title} {Title}: {noun} kept", "Step {dd}, {Title} {Title}, Unit {d}", "on {Title} {dd} the {noun} ran", "{noun}@{d}.{dd}.{d} pinned", "lane {dd} Road closed", "see chapter {dd} Court",
    '{{"path":"{file}","lines":"{ddd}-{ddd}"}}', '{{"path":"{file}","lines":"{dddd}-{dddd}"}}', '{{"path":"{file}","lines":"{d}-{ddd}"}} --trace {uuid}', '{{"lines":"{dd}-{ddd}"}} {{"requestId":"req-{hex}"}}', '{{"path":"{file}","lines":"{ddd}-{dddd}"}} # attempt {d}', '{{"requestId":"req-{hex}"}}', "--trace {uuid}", "{uuid}", "span {uuid} closed",
    "blob {hex}{hex} of {file}", "open {file} > /tmp/{noun}-{hex}.log", "--stamp=1{dddd}{dddd}{dddd} --parent-pid {dddd}", "lines {dddd}-{dddd} of {file}", "range {dddd}-{dddd}, {ddd}-{ddd}", "commit {hex} by bot", "{hex} {noun} {verb}", "since 20{dd}-0{d}-1{d}T0{d}:{dd}:{dd}Z in {file}",
    "retry in {ddd} {dddd} ms", "code {ddd}-{ddd}", "span {dddd} {dddd}", "pid {ddd}{dd}", "{Word} the {noun} first", "{Word} it {verb} late",
]
_ITEMS = [
    "Reported by {name} on the {noun} desk.", "According to {name} the {noun} was stable.", "owner: {name}\nphone: {phone}\nstreet: {addr}", "contact: {email}", "cc {email} and {email}", "Sent a copy to {email} by mistake.", "Bitte {email} in Kopie nehmen; Ausweis {id} liegt vor.", "邮件已发送至{email}。", "请联系{name}（{phone}）。", "由{name}处理，电话{phone}。",
    "Neither {name} nor the {noun} owner had seen it.", "We promised {name} and {name} an answer by noon.", "{name} was on call that night.", "{name} said so.", "Reviewer {name} <{email}> approved it.", "lease held by {name} since the restart", "permission denied: owner {name}", "KeyError: '{name}'", "2025-03-1{d} 09:1{d}:4{d} INFO session opened by {name} from lane {d}",
    "# ping {name} when done", '--author "{name}"', "--notify {email}", "owner={email}", "--subject-id {id}", "--filter 'phone={phone}'", "--where \"addr='{addr}'\"", "# asked by {name}, {phone}", "# asked by {name}", "passport no. {id}, holder {name}", "national id {id} was pasted into the prompt", "ssn: {id} tel={phone}", "ssn: {id}",
    '{{"person":{{"full":"{name}","tel":"{phone}","nid":"{id}"}}}}', '{{"assignee":"{name}","mail":"{email}"}}', "GET /v1/people?mail={email}&state=open 200", "auth refused for {email}", "mailbox {email} bounced, fallback {phone}", "ValidationError: phone '{phone}' does not match", "address line rejected: {addr} (user {email})", "cannot geocode '{addr}'",
    "The ticket says {name} lives at {addr} and can be reached under {phone}.", "Moved to {addr} last week, says {name}.", "shipping label: {addr}", "Rückfragen an {name}, {addr}, Tel. {phone}", "caller={name}; phone={phone}; note=wants the export", "Call back {phone} before the rerun.", "Thanks, {name}", "{name}", "{email};{phone};{addr};open", "row {dd} | {name} | {email} | {phone} | open",
    "Escribe a {name} o llama al {phone}.", "Vive en {addr}.", "Herr {name} wohnt {addr}.", "tel {phone} / {email}", "mail {email}, tel {phone}", "{name} ({email})", "Signed-off-by: {name} <{email}>", "visit {addr} or call {phone}", "id number {id}; name {name}", "DNI {id}", "{phone} was dialled twice", "{addr} is the old address", "From: {name}", "{name}, {phone}, {addr}",
    "Según {name}, el envío va a {addr}.", "Laut {name} ging alles an {addr}.", "Selon {name}, tout va bien.", "Dice {name} que no.", "deliver to: {name}, {addr}", "{name} asked us to resend the archive to {addr}.", "Frau {name} schrieb an {email}.", "Señora {name} llamó.", "{name}。", "收件人{name}，地址{addr}", "({name})", "({id})", "rejected ({id}) for {name}", "(tel {phone})", "[{id}]", "({phone})", "nid={id};", "Hi {name},", "- {name}\n- {name}", "{name}; {email}", "| {name} | {id} |", "said {name}.", "by {name}", "\"{name}\" wrote",
    "{name} <{email}>", "owner: {name}", "holder {id}", "Ausweisnummer {id}", "Personal-ID {id} ({name})", "{addr}; {phone}", "send it to {addr}, attention {name}", "for {name} only", "Cheers, {name}", "Regards\n{name}", "Gruß, {name}", "Un saludo, {name}",
    '{{"assignee":"{name}","mail":"{email}"}}', '"user":"{name}","mail":"{email}"', "邮件已发送至{email}，收件人{name}。", '{{"mail":"{email}"}}', "shipping label: {addr}\n{file}:{n}: {adj} {noun}",
    "the letter returned from {addr}: no such house", "{addr}: locked", "The van came from {addr}: empty.", "It goes to {addr}. {{\"rows\":{n}}}", "sent from {addr} to {addr}", "{addr} {noun} {verb}", "{phone} {noun} {verb}", "{name} {noun} {verb}", "{email} {noun} {verb}", "parcel for {name} at {addr}: refused",
    "the note by {name} mentions {addr}", "Best, {name}", "Dr. {name} called", "ask {name} or {name} about the {noun}", "身份证{id}已登记。", "地址是{addr}。", "fax: {phone}", "customer {name} paid, {id} checked", "user {email} from {addr}", "assigned to {name}.", "{name}: {phone}", "{name} and {name} disagree.", "lives at {addr}", "deliver to {name}, {addr}",
]


def _ascii(s: str) -> str:
    return re.sub(r"[^a-z-]", "", unicodedata.normalize("NFKD", s.replace("ø", "o").replace("ł", "l").lower()).encode("ascii", "ignore").decode())


class Table:
    def __init__(self, lexicon: list[tuple[str, str]], seed: int = 3, items: list[str] | None = None):
        self.rng, self.items = random.Random(seed), _ITEMS if items is None else items
        self.given = [p for p, k in sorted(lexicon) if k == "given"]
        self.family = [p for p, k in sorted(lexicon) if k == "family"]

    def _invented(self) -> str:
        r = self.rng
        return (r.choice("B D F G H K L M N P R S T V W Y Z St Br Kr Th Qu El Or".split()) + "".join(r.choice("an er ol is und ar ew in os eth il or am ay ink el".split()) + r.choice("d f g l m n r s t v w th rk nd ll ss".split()) for _ in range(r.choice((1, 1, 2))))
                + r.choice(["", "a", "en", "wick", "moor", "ard", "or", "by", "o", "in"])).capitalize()

    def parts(self) -> tuple[str, str]:
        r = self.rng
        g = r.choice(self.given) if self.given and r.random() < 0.5 else r.choice(_GIVEN) if r.random() < 0.5 else self._invented()
        f = r.choice(self.family) if self.family and r.random() < 0.5 else r.choice(_FAMILY).replace("_", " ") if r.random() < 0.5 else self._invented()
        return g, f

    def name(self) -> str:
        r, (g, f) = self.rng, self.parts()
        k = r.random()
        if k < 0.56:
            out = f"{g} {f}"
        elif k < 0.71:
            out = f"{f}, {g}"
        elif k < 0.80:
            out = f"{g} {r.choice('ABCDEFGHJKLMNPRSTW')}. {f}"
        elif k < 0.90:
            out = f"{g} {f[0].upper()}."
        elif k < 0.92:
            out = f"{g[0]}. {f}"
        else:
            return f"{g} {f}".upper()
        return out

    def email(self) -> str:
        r, (g, f) = self.rng, self.parts()
        g, f = _ascii(g) or "ab", _ascii(f) or "cd"
        local = r.choice([f"{g}.{f}", f"{g[0]}{f}", f"{f}-{g[0]}", f"{f}_{g}", f"{g}{r.randrange(100):02d}", f"{g}.{f}+ops", g])
        host = r.choice(_HOSTS)
        k = r.random()
        if k < 0.60:
            return f"{local}@{host}"
        if k < 0.70:
            return f"{local}%40{host}"
        if k < 0.80:
            return f"{local} @ {host}"
        if k < 0.88:
            return f"{local} [at] {host.replace('.', ' [dot] ')}"
        if k < 0.92:
            return f"{local} (at) {host.replace('.', ' (dot) ')}"
        if k < 0.95:
            return f"{local}[at]{host}"
        return f"{local}@{host}".upper()

    def phone(self) -> str:
        r = self.rng
        d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        a, b, c = r.choice("23456789") + d(2), "555" if r.random() < 0.7 else d(3), d(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+1{a}{b}{c}", f"+49 {d(2)} {d(5)} {d(3)}", f"0049 {d(2)} {d(8)}", f"0{d(2)}/{d(5)}-{d(3)}", f"+44 {d(4)} {d(6)}", f"0{d(4)} {d(3)} {d(3)}", f"+44 {d(4)} {d(3)} {d(3)}", f"+34 {d(3)} {d(2)} {d(2)} {d(2)}", f"+86 1{d(2)} {d(4)} {d(4)}", f"+1.{a}.{b}.{c}", f"+49{d(10)}"])

    def id(self) -> str:
        r = self.rng
        d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"QQ{d(6)}{r.choice('ABCD')}", f"QQ {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"99{d(4)}19{d(2)}{r.choice(['03', '11', '07'])}{r.choice(['12', '25', '08'])}{d(3)}X", f"99{d(4)}20{d(2)}{r.choice(['03', '11'])}{r.choice(['12', '25'])}{d(4)}", f"P{d(7)}{r.choice('YZK')}", f"{r.choice('XYZ')}{d(7)}{r.choice('ABHK')}"])

    def addr(self) -> str:
        r = self.rng
        if r.random() < 0.5:
            out = f"{r.randrange(1, 999)} {r.choice(_STREETS)} {r.choice(_SUFFIX)}"
            if r.random() < 0.4:
                out += f", {r.choice(['Unit', 'Apt', 'Flat', 'Suite'])} {r.randrange(1, 19)}{r.choice('ABC')}"
                out += f", {r.choice(_TOWNS)}" if r.random() < 0.8 else ""
            return out
        street = r.choice(_DE_STEM) + r.choice(_DE_END) if r.random() < 0.6 else f"{r.choice(_DE_FRONT)} {r.choice(_DE_NOUN)}"
        out = f"{street} {r.randrange(1, 150)}{r.choice(['', '', '', 'a', 'b'])}"
        return out + (f", {r.randrange(10000, 99999)} {r.choice(_TOWNS)}" if r.random() < 0.4 else "")

    def fill(self, pattern: str) -> tuple[str, list[tuple[int, int, str]]]:
        r, out, spans = self.rng, "", []
        for piece in re.split(r"(\{\{|\}\}|\{\w+\})", pattern):
            slot = piece[1:-1] if piece.startswith("{") and piece.endswith("}") and len(piece) > 2 else None
            if piece in ("{{", "}}"):
                out += piece[0]
            elif slot is None:
                out += piece
            elif slot in ("name", "email", "phone", "id", "addr"):
                item = getattr(self, slot)()
                spans.append((len(out), len(out) + len(item), {"id": "id_number", "addr": "address"}.get(slot, slot)))
                out += item
            elif re.fullmatch("d+", slot):
                out += "".join(r.choice("0123456789") for _ in slot)
            else:
                word = lambda: r.choice([g for g in self.given if g.isascii()] or _GIVEN) if r.random() < 0.7 else r.choice("Mark Will Grant Hope Grace Faith Chase Bill Rob Dawn Rich".split())
                out += {
                    "n": lambda: str(r.choice([2, 7, 12, 40, 96, 250, 512, 1800])), "noun": lambda: r.choice(_NOUNS), "adj": lambda: r.choice(_ADJ), "verb": lambda: r.choice(_VERBS), "file": lambda: r.choice(_FILES),
                    "Title": lambda: r.choice(_TITLE), "Town": lambda: r.choice(_TOWNS).split()[0], "Word": word, "Street": lambda: r.choice(_STREETS),
                    "hex": lambda: f"{r.getrandbits(40):010x}", "uuid": lambda: str(uuid.UUID(int=r.getrandbits(128))),
                }[slot]()
        return out, spans

    def row(self) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.rng
        kinds = [r.choices((self.items, _DECOYS, _FILLER), (5, 4, 3))[0] for _ in range(r.choice((1, 2, 2, 3)))]
        text, spans = "", []
        for k, patterns in enumerate(kinds):
            if k:
                text += r.choice([" ", "\n", "\n", "; ", " "])
            elif r.random() < 0.1:
                text += "("
            part, own = self.fill(r.choice(patterns))
            spans += [(a + len(text), b + len(text), c) for a, b, c in own]
            text += part
        return text, spans


def rows(lexicon: list[tuple[str, str]], n: int = 3200, seed: int = 3, items: list[str] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n labelled rows; lexicon: (name part, given or family), known parts that half of the names use. items: the patterns with items, all by default."""
    table = Table(lexicon, seed, items)
    return [table.row() for _ in range(n)]


def folds(of: int) -> list[tuple[list[str], list[str]]]:
    """(kept, left out): the item patterns in `of` ways without every `of`-th, so that accuracy can be measured on patterns that weren't learnt."""
    return [([p for i, p in enumerate(_ITEMS) if i % of != k], [p for i, p in enumerate(_ITEMS) if i % of == k]) for k in range(of)]
