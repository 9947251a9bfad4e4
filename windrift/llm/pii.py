"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, schemes and
identifier cues. A deterministic local parser then expands each anchor to its borders and validates it.
The four base kinds equal a leftmost, non-overlapping search for their patterns; further
spans (written-out at-signs, credentials in addresses, account numbers, IBANs, secrets) are added beside them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import slices
from .storage import aside, wider

#: Kinds in the order of output; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "account", "iban", "secret", "userinfo")
#: Cue words and the parser that they start.
CUES = {
    "account": ("account", "acct", "konto", "compte", "cuenta"),
    "iban": ("iban",),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key"),
    "written": ("[at]", "(at)", " at "),
}
SPAN = "array<struct<kind: string, start: int, end: int, base: boolean>>"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOT = re.compile(r" ?(?:\[dot\]|\(dot\)| dot )[ ]?")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_NUMBER = re.compile(r"\W{0,3}(?:no|nr|number)?\W{0,3}([0-9](?:[ -]?[0-9]){5,17})(?![0-9])", re.IGNORECASE)
_IBAN = re.compile(r"\W{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SECRET = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_+/=.-]{16,})")
_USER = re.compile(r"[^\s/@:]+:[^\s/@]+(?=@)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in _DIGITS:
        found.add_word(c, ("digit", 1))
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        found.add_word(word, (kind, len(word)))
    for kind, words in CUES.items():
        for w in words:
            for form in {w, w.upper(), w.title()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


_shared: list[ahocorasick.Automaton] = []


def _local_start(text: str, at: int, floor: int) -> int:
    while at > floor and text[at - 1] in _LOCAL:
        at -= 1
    return at


def find_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) in code points, end exclusive, sorted by kind as in KINDS, then start."""
    if not _shared:
        _shared.append(_automaton())
    out: set[tuple[str, int, int, bool]] = set()
    email = ip = card = 0  # where the last match of the kind ended
    for last, (kind, size) in _shared[0].iter(text):
        at = last + 1 - size
        if kind == "digit":
            if at >= ip:
                m = _DOTTED.match(text, at)
                ip = m.end()
                parts = m.group().split(".") if ip - at >= 7 else ()
                begin = at
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    end = begin + sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                        out.add(("ip", begin, end, True))
                    begin = end + 1
            if at >= card and (m := _CHAIN.match(text, at)):
                card = m.end()
                digits = m.group().replace(" ", "").replace("-", "") if card - at < 40 else ""
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.add(("card", at, card, True))
        elif kind == "at":
            if (begin := _local_start(text, at, email)) < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                out.add(("email", begin, email, True))
        elif kind == "plus":
            if (m := _PHONE.match(text, at)) and 9 <= sum(c in _DIGITS for c in m.group()) <= 15:
                out.add(("phone", at, m.end(), True))
        elif kind == "scheme":
            if m := _USER.match(text, last + 1):
                out.add(("userinfo", m.start(), m.end(), False))
        elif kind == "written":
            _written(text, at, last + 1, out)
        elif kind == "account" and (m := _NUMBER.match(text, last + 1)):
            out.add(("account", m.start(1), m.end(1), False))
        elif kind == "iban" and (m := _IBAN.match(text, last + 1)):
            code = m.group(1).replace(" ", "")
            if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                out.add(("iban", m.start(1), m.end(1), False))
        elif kind == "secret" and (m := _SECRET.match(text, last + 1)):
            out.add(("secret", m.start(1), m.end(1), False))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _written(text: str, at: int, after: int, out: set) -> None:
    """name [at] host [dot] org: at least one written-out dot is needed."""
    end = at - 1 if at and text[at - 1] == " " else at
    begin = _local_start(text, end, 0)
    m = _LABEL.match(text, after + 1 if text[after : after + 1] == " " else after)
    if begin == end or not m:
        return
    labels = 1
    while (dot := _DOT.match(text, m.end())) and (more := _LABEL.match(text, dot.end())):
        m, labels = more, labels + 1
    if labels > 1:
        out.add(("email", begin, m.end(), False))


def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """Each stretch of overlapping spans becomes the name of the first of them, in angle brackets."""
    parts, done = [], 0
    for kind, begin, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin >= done:
            parts += [text[done:begin], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def _mapped(docs: DataFrame, clean: bool) -> DataFrame:
    docs = docs.drop("pii")
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = batch.column(text).to_pylist()
            found = [find_spans(t) if t else [] for t in texts]
            columns = list(batch.columns)
            if clean:
                columns[names.index(text)] = pa.array([redact(t, s) if s else t for t, s in zip(texts, found, strict=True)], pa.string())
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
            spans = pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in one] for one in found], kind)
            yield pa.RecordBatch.from_arrays([*columns, spans], names=[*names, "pii"])

    df = docs.toDF(*names)
    return df.mapInArrow(run, wider(df, f"pii {SPAN}")).toDF(*docs.columns, "pii")


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii``, the spans of ``text``. Null and empty texts have none. An input column ``pii`` is replaced."""
    return _mapped(docs, False)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind; a null text stays null. ``n_chars``, if present, is counted anew."""
    plain, restored = aside(docs, "text", "n_chars")
    out = _mapped(plain, True)
    return restored(out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out)


def digest(spans: Column) -> Column:
    """kind:start:end of all, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s.base)
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")
    counts = [count(base, k).alias(f"n_{k}") for k in KINDS[:4]]
    added = [count("pii", k).alias(f"n_{k}") for k in KINDS[4:]]
    return found.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"), *added)


QUERIES = {"op8_pii": op8_pii}
ORACLE_SQL: dict[str, str] = {}
