"""Secret scans: fixed patterns, and formats learnt from labelled credentials.

The patterns give the base spans. The credentials that they find in the corpus
are labelled examples, and so are strings made by the rules of public formats
(``PUBLIC_FORMATS``). They are grouped by format, and from a bounded,
deterministic sample of each group one probabilistic automaton is inferred by
state merging (``automata``), and one from ordinary words. Then every candidate,
a run of credential characters or the value of an assignment, is scored whole
by its likelihood under each format against that of ordinary text, and becomes
a ``format`` span where a format clearly wins and no base span is the same.
Where the whole is no format, what base spans leave of it is scored piece by
piece, and so are its parts between dots. The shortest learnt example sets how
short a run may be.

The sample (``SAMPLE_PER_LABEL`` strings a label of at most ``SAMPLE_CHARS``
characters, the least by hash; longer ones are not learnt from) bounds the fit
alone; all texts are scanned whole, and candidates of any length are scored.
Rows are handled one by one and nothing but the sample is shuffled.

Nulls: a null text is the empty text, with no spans. Empty tables fit no
automata and give no rows. Repeated rows are scanned as often as they occur;
equal texts have equal spans. Spans that start together are in the order of
KINDS, then by end; of equally likely formats it does not matter which wins.
Very long texts and very long words cost in proportion to their length. Other
columns are kept out of the way.
"""

from __future__ import annotations

import math
import random
import re
import string
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Format, Ordinary, grouped
from .common import lean, modest_batches, stored, table, text_or_empty

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
#: What the automata score: long runs of the characters that credentials are made of, no shorter than any base kind takes.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
#: Runs of so many characters are scored whatever the learnt examples' lengths.
CANDIDATE_CHARS = 16
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{6,128}")
KINDS = ("assign", "access", "hex", "format")

SAMPLE_PER_LABEL = 400
SAMPLE_CHARS = 128
#: A format must beat ordinary text by so many nats a character.
MARGIN = 0.35

ALNUM, URL64, BASE64, UPPER_HEX = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_", string.ascii_letters + string.digits + "+/", "0123456789ABCDEF"
#: Public formats of credentials, as literal parts and (alphabet, length) of random ones.
PUBLIC_FORMATS = {
    "github": ["ghp_", (ALNUM, 36)],
    "gitlab": ["glpat-", (URL64, 20)],
    "stripe": ["sk_live_", (ALNUM, 24)],
    "google": ["AIza", (URL64, 35)],
    "npm": ["npm_", (ALNUM, 36)],
    "sendgrid": ["SG.", (URL64, 22), ".", (URL64, 43)],
    "slack": ["xoxb-", (string.digits, 12), "-", (string.digits, 12), "-", (ALNUM, 24)],
    "cloud secret": [(BASE64, 40)],
    "padded key": [(BASE64, 43), "="],
    "upper hex 40": [(UPPER_HEX, 40)],
    "upper hex 64": [(UPPER_HEX, 64)],
}
EXAMPLES_PER_FORMAT = 80


def public_examples(name: str, n: int = EXAMPLES_PER_FORMAT) -> list[str]:
    """Strings of a public format, always the same."""
    rng = random.Random(name)
    return ["".join(part if isinstance(part, str) else "".join(rng.choices(part[0], k=part[1])) for part in PUBLIC_FORMATS[name]) for _ in range(n)]


@dataclass
class Formats:
    """The learnt formats by name, the likelihood of ordinary words, and the least length to score."""

    learnt: dict[str, Format]
    ordinary: Ordinary
    least: int = CANDIDATE_CHARS

    def score(self, text: str) -> float:
        """Nats a character by which the best fitting format beats ordinary text; -inf where none fits."""
        fitting = [one.per_symbol(text) for one in self.learnt.values() if one.fits(text)]
        return max(fitting) - self.ordinary.per_symbol(text) if fitting else -math.inf


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]], list[tuple[str, str]]]:
    """Base spans (kind, start, end), the candidates' (start, end), and labelled credentials (kind, value)."""
    found, labelled, candidates = [], [], []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_CHARS:
                found.append(("assign", m.start(), m.end()))
                labelled.append(("assign", m[2]))
                candidates.append(m.span(2))
    if b"akia" in low:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_CHARS:
                found.append(("access", m.start(), m.end()))
                labelled.append(("access", m[0]))
    for c in CANDIDATE.finditer(text):  # a run of 16 hexadecimal digits lies in a candidate
        candidates.append(c.span())
        if c.end() - c.start() < HEX_CHARS:
            continue
        for m in HEX.finditer(text, c.start(), c.end()):
            if m.end() - m.start() >= HEX_CHARS:
                found.append(("hex", m.start(), m.end()))
                labelled.append(("hex", m[0]))
    return found, candidates, labelled


def _is_format(text: str, start: int, end: int, formats: Formats) -> bool:
    return end - start >= formats.least and formats.score(text[start:end]) >= MARGIN


def _stripped(text: str, start: int, end: int, edges: str) -> tuple[int, int]:
    piece = text[start:end]
    return start + len(piece) - len(piece.lstrip(edges)), max(end - len(piece) + len(piece.rstrip(edges)), start)


def _left_over(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What sorted spans leave of a range."""
    pieces, free = [], start
    for s, e in taken:
        if s > free:
            pieces.append((free, min(s, end)))
        free = max(free, e)
    if free < end:
        pieces.append((free, end))
    return pieces


def format_spans(text: str, found: list[tuple[str, int, int]], candidates: list[tuple[int, int]], formats: Formats) -> set[tuple[int, int]]:
    """The ranges of a format among the candidates, or else among their parts."""
    taken, hits = sorted((s, e) for _, s, e in found), set()
    base, at = set(taken), 0
    for start, end in sorted(set(candidates)):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        s, e = _stripped(text, start, end, ".")
        if _is_format(text, s, e, formats):
            hits.add((s, e))
            continue
        overlaps, k = [], at
        while k < len(taken) and taken[k][0] < end:
            overlaps += [taken[k]] if taken[k][1] > start else []
            k += 1
        pieces = _left_over(start, end, overlaps) if overlaps else []
        if "." in text[s:e]:
            pieces += [(s + m.start(), s + m.end()) for m in re.finditer(r"[^.]+", text[s:e])]
        for x, y in pieces:
            for edges in (".", ".-_"):
                s, e = _stripped(text, x, y, edges)
                if _is_format(text, s, e, formats):
                    hits.add((s, e))
                    break
    return hits - base


def find_spans(text: str, formats: Formats | None) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as in KINDS; base spans always stay."""
    found, candidates, _ = base_spans(text)
    if formats is not None and candidates:
        found += [("format", s, e) for s, e in format_spans(text, found, candidates, formats)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def least_chars(examples: dict[str, list[str]]) -> int:
    """The length of the shortest example, at most CANDIDATE_CHARS."""
    return min([CANDIDATE_CHARS, *(len(v) for values in examples.values() for v in values)])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def learn_formats(df: DataFrame, text_column: str = "text", per_label: int = SAMPLE_PER_LABEL) -> Formats | None:
    """Formats from the credentials in these texts and the public ones, against one ordinary word of each text; None for a table without either."""
    modest_batches(df.sparkSession)

    def work(batches):
        for batch in batches:
            labels, values = [], []
            for cell in batch.column(0):
                text = cell.as_py()
                _, _, labelled = base_spans(text)
                for kind, value in labelled:
                    if len(value) <= SAMPLE_CHARS:
                        labels.append(kind)
                        values.append(value)
                if text:
                    word = ORDINARY.search(text, xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) % len(text))
                    if word and not HEX.fullmatch(word[0]) and not any(word[0] in v for _, v in labelled):
                        labels.append("ordinary")
                        values.append(word[0])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(values, pa.string())], names=["label", "value"])

    examples = stored(df.select(text_or_empty(text_column).alias("text")).mapInArrow(lean(work), "label string, value string").distinct())
    picked = {}
    for label in ("assign", "access", "hex", "ordinary"):
        rows = examples.where(F.col("label") == label).orderBy(F.xxhash64("value"), "value").limit(per_label).collect()
        picked[label] = [r["value"] for r in rows]
    ordinary = picked.pop("ordinary")
    if not ordinary and not any(picked.values()):
        return None
    examples_of = {f"public {name}": public_examples(name) for name in PUBLIC_FORMATS}
    for label, values in picked.items():
        examples_of |= {f"{label} {key}": own for key, own in grouped(values).items()}
    return Formats({name: Format(values) for name, values in examples_of.items()}, Ordinary(ordinary), least_chars(picked))


def scan(df: DataFrame, formats: Formats | None, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The ``keep`` columns and spans: an array of (kind, start, end) in code points, by start, then kind."""
    plain = df.select(F.struct(*keep).alias("kept"), text_or_empty(text_column).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches):
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(x.as_py(), formats)] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(spans, span)], names=["kept", "spans"])

    kept = plain.schema["kept"].dataType.simpleString()
    return plain.mapInArrow(lean(work), f"kept {kept}, spans array<struct<kind:string,start:bigint,end:bigint>>").select("kept.*", "spans")


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(df: DataFrame, formats: Formats | None, text_column: str = "text", chars_column: str = "n_chars") -> DataFrame:
    """The same rows and columns with secrets replaced in the text; the column of its length, if there, follows. A null text stays null."""
    names = df.columns
    plain = df.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("kept"), F.col(text_column).cast("string").alias("found_text"))

    def work(batches):
        for batch in batches:
            texts = []
            for cell in batch.column("found_text"):
                text = cell.as_py()
                spans = find_spans(text, formats) if text else []
                texts.append(redacted(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(texts, pa.string())], names=["kept", "new_text"])

    kept = plain.schema["kept"].dataType.simpleString()
    done = plain.mapInArrow(lean(work), f"kept {kept}, new_text string")

    def column(name: str):
        old = F.col("kept").getField(name)
        if name == text_column:
            return F.col("new_text").alias(name)
        if name == chars_column:
            return F.when(F.col("kept").getField(text_column).eqNullSafe(F.col("new_text")), old).otherwise(F.length("new_text").cast(df.schema[name].dataType)).alias(name)
        return old.alias(name)

    return done.select(*(column(n) for n in names))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: spans of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, learn_formats(docs))

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(F.filter("spans", lambda x: x["kind"] != "format")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count("format"))
