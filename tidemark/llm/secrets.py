"""Operator 5: secret scans by patterns and by the guess cost of credential values.

Three kinds of spans come from patterns: assignments of long values to credential names, access key
ids, and long hexadecimal runs. The method adds a fourth: every value in a credential context (more names
than the pattern knows, also glued to a prefix, any characters; in quotes up to the closing quote) is
cut as a whole into words, dates, repeats, keyboard walks and brute-force spans so that the number of
guesses is least, by dynamic programming over the value's characters; a value that takes 10 ** `LEAST`
guesses or more is a span of kind `guess`, unless spans from patterns cover all of it. How soon guesses try a
word is its rank in the corpus (`word_ranks`, a bounded list counted over all documents), after a short fixed list. Redaction takes
the union of the spans, and the whole of any value that a pattern's span touches.

Places count code points, ends are exclusive. The whole of every text is scanned, row by row, without a
shuffle. A null or empty text has no spans; repeated rows are scanned each; null keys pass through; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._spark import prepare, written
from tidemark.llm._text import LOWER, pieces, words

#: Bytes of words: lower-case letters and everything outside ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run's first match takes all of it
#: Quoted values end at the same quote of the line; others at a blank, a closing quote, a tag, or a comma or semicolon before a blank or the next name.
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pass|pwd|secret|token|api_?key|access_?key|private_?key|credentials?|auth|bearer)["']?[ \t]*[:=][ \t]*"""
    r"""(?:"((?:\\.|[^"\\\r\n])*)"|'((?:\\.|[^'\\\r\n])*)'|`([^`\r\n]*)`|["'`]?((?:[^\s"'`,;<]|[,;](?=[^\s"'`,;])(?![\w.-]{1,64}["']?[ \t]*[:=])|["'`](?=\w)|<(?!/?[a-z!][^<>\r\n]{0,200}>))+))""",
    re.ASCII | re.IGNORECASE,
)
SHORTEST = 6
#: What a text needs for ASSIGN or CONTEXT to match at all.
_NAMES = ("pass", "pwd", "secret", "token", "apikey", "api_key", "accesskey", "access_key", "privatekey", "private_key", "credential", "auth", "bearer")

#: log10 of the guesses from which a value counts as a secret.
LEAST = 8.0
# Words that guesses try first, in their order.
WORDS = (
    "password 123456 qwerty letmein admin welcome login abc123 monkey dragon master hello freedom whatever trustno1 iloveyou sunshine princess "
    "football baseball shadow superman michael jordan secret test guest root user default changeme example sample dummy null none true false "
    "token key value your here insert enter placeholder string public private access server database mysql postgres oracle redis docker "
    "summer winter spring autumn monday friday january december love money blue green black white red house dog cat name john anna "
    "the and that have for not with you this but his from they say her she will one all would there their what out about who get which when make can like "
    "time just him know take people into year good some could them see other than then now look only come its over think also back after use two how our "
    "everything something required optional missing unknown hidden removed redacted masked forgotten expired invalid number"
).split()
#: Words that the corpus adds, and their greatest length.
MOST, LONGEST = 20_000, 20


def _ranks(words: list[str]) -> dict[str, float]:
    """log10 of the guesses after which each of the words has been tried."""
    return {w: math.log10(i + 2) for i, w in enumerate(dict.fromkeys(words))}


_RANK = _ranks(WORDS)
_LEET = str.maketrans("40351$7@", "aoesista")
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_NEXT: dict[tuple[str, str], frozenset] = {}
for _row in _ROWS:
    for _a, _b in zip(_row, _row[1:], strict=False):
        _NEXT[_a, _b] = _NEXT.get((_a, _b), frozenset()) | {(_row, 1)}
        _NEXT[_b, _a] = _NEXT.get((_b, _a), frozenset()) | {(_row, -1)}
_DATE = re.compile(r"(19|20)\d\d([-/.]?)(0[1-9]|1[0-2])\2(0[1-9]|[12]\d|3[01])|(0[1-9]|[12]\d|3[01])([-/.]?)(0[1-9]|1[0-2])\6(19|20)\d\d|(19|20)\d\d", re.ASCII)
_DATES = {4: math.log10(200), 6: math.log10(366 * 100)}
#: Guesses to choose where a segment ends and of which sort the next is.
_SEGMENT = 0.5


def _alphabet(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000)


def guess_cost(value: str, ranks: dict[str, float] | None = None) -> float:
    """log10 of the guesses for the cheapest cut of the value into segments. `ranks` are words with log10 of their
    guesses. Repeats and walks are taken from where they begin, so the work is linear in the length."""
    ranks = _RANK if ranks is None else ranks
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(_LEET)
    forms = ((low, 0.0),) if plain == low else ((low, 0.0), (plain, 0.5))
    best = [0.0] + [math.inf] * n
    run = walk = 0
    dates: dict[int, list[int]] = {}
    for i in range(n):
        m = _DATE.match(value, i) if low[i].isdigit() else None
        if m:
            dates.setdefault(m.end(), []).append(i)
    ways: frozenset = frozenset()
    for i in range(1, n + 1):
        c = value[i - 1]
        cost = best[i - 1] + _alphabet(c) + (_SEGMENT if i == 1 else 0)
        for length in range(3, min(LONGEST, i) + 1):
            j = i - length
            for form, extra in forms:
                rank = ranks.get(form[j:i])
                if rank is not None:
                    case = 0.0 if value[j:i] in (low[j:i], value[j:i].upper()) else 0.3 if value[j + 1 : i] == low[j + 1 : i] else math.log10(2) * length
                    cost = min(cost, best[j] + _SEGMENT + rank + case + extra)
        for j in dates.get(i, ()):
            cost = min(cost, best[j] + _SEGMENT + _DATES.get(i - j, math.log10(366 * 200) + 0.5))
        if i > 1 and value[i - 2] == c:
            if i - run >= 3:
                cost = min(cost, best[run] + _SEGMENT + _alphabet(c) + math.log10(i - run))
        else:
            run = i - 1
        now = _NEXT.get((low[i - 2], low[i - 1])) if i > 1 else None
        if now is None:
            walk, ways = i - 1, frozenset()
        else:
            if not ways & now:
                walk, ways = i - 2, now
            ways &= now
            if i - walk >= 3:
                cost = min(cost, best[walk] + _SEGMENT + math.log10(94) + math.log10(i - walk))
        best[i] = cost
    return best[n]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or meet become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _found(text: str, ranks: dict[str, float] | None = None) -> tuple[list[tuple[int, int, int, int, float | None]], list[tuple[int, int]]]:
    """The spans of scan(), and what redaction takes out."""
    out: list[tuple[int, int, int, int, float | None]] = []
    low = text.lower()
    named = any(x in low for x in _NAMES)
    if named:
        out += [(m.start(), 0, m.end(), m.start(2), guess_cost(m[2], ranks)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), m.start(), None) for m in HEX.finditer(text)]
    gone = _union([(v, e) for _, _, e, v, _ in out])
    if named:
        base, at, more, m = gone, 0, [], CONTEXT.search(text)
        while m:
            a, b = m.span(m.lastindex)
            while at < len(base) and base[at][1] <= a:
                at += 1
            touched = at < len(base) and base[at][0] < b
            covered = touched and base[at][0] <= a and b <= base[at][1]
            cost = guess_cost(text[a:b], ranks) if b - a >= SHORTEST and not covered else 0.0
            if cost >= LEAST:
                out.append((a, 3, b, a, cost))
            if touched or cost >= LEAST:
                more.append((a, b))
            m = CONTEXT.search(text, b if touched or cost >= LEAST else a)  # a weak value may hold the next name
        gone = _union(base + more)
    return sorted(out, key=lambda x: x[:3]), gone


def word_ranks(docs: DataFrame, text: str = "text", most: int = MOST) -> dict[str, float]:
    """WORDS and the corpus's most frequent words of 3 to `LONGEST` bytes (letters alone; ties by the word), `most` at most,
    in the order in which guesses try them. Values in credential contexts are not counted, so that a secret which
    many documents repeat does not become a word."""
    prepare(docs.sparkSession)
    blank = lambda m: m[0][: m.start(m.lastindex) - m.start()] + " "

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text):
                texts = []
                for t in part.column(text).to_pylist():
                    low = (t or "").lower()
                    if any(x in low for x in _NAMES):
                        t = CONTEXT.sub(blank, ASSIGN.sub(" ", t))
                    texts.append(t)
                w = words(pa.array(texts, pa.string()), LETTERS, lower=True)
                length = w.end - w.start
                fits = np.flatnonzero((length >= 3) & (length <= LONGEST))
                _, first, n = np.unique(w.hash[fits], return_index=True, return_counts=True)
                first = fits[first]
                data = LOWER[w.data].tobytes()
                found = [data[a:b].decode() for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    counted = docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # Counts within a hundredth of each other are one level; as many whole levels as fit, from the top, are taken.
    counted = written(counted.withColumn("level", F.floor(F.log2(F.col("n").cast("double")) * 64)), "word-counts")
    cut, total = math.inf, 0
    for r in sorted(counted.groupBy("level").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.level):  # 64 * 63 rows at most
        total += r.words
        if total > most:
            break
        cut = r.level
    top = counted.where(F.col("level") >= cut).select("word", "n").collect() if cut < math.inf else []  # `most` at most
    return _ranks([*WORDS, *(r.word for r in sorted(top, key=lambda r: (-r.n, r.word)))])


def scan(text: str, ranks: dict[str, float] | None = None) -> list[tuple[int, int, int, int, float | None]]:
    """Spans (start, kind by its place in KINDS, end, where the value starts, log10 guesses) in order."""
    return _found(text, ranks)[0]


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: dict[str, float] | None = None) -> DataFrame:
    """One row per document: key and spans (kind, start, end, value_start, log10_guesses) by start, then kind. `ranks`
    are those of `word_ranks`, or of WORDS alone."""
    prepare(docs.sparkSession)
    fields = [("kind", T.StringType(), pa.string()), ("start", T.LongType(), pa.int64()), ("end", T.LongType(), pa.int64()), ("value_start", T.LongType(), pa.int64()), ("log10_guesses", T.DoubleType(), pa.float64())]
    schema = T.StructType([docs.schema[key], T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, t) for n, t, _ in fields])))])
    kind = pa.list_(pa.struct([(n, t) for n, _, t in fields]))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text):
                rows = [[{"kind": KINDS[k], "start": s, "end": e, "value_start": v, "log10_guesses": c} for s, k, e, v, c in scan(t, ranks)] if t else [] for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(rows, kind)], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", count: str = "n_secrets", ranks: dict[str, float] | None = None) -> DataFrame:
    """docs with every secret value in the text replaced by the mark, and the number of spans in a column `count`."""
    prepare(docs.sparkSession)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(count, T.LongType())])

    def clean(t: str | None) -> tuple[str | None, int]:
        found, gone = _found(t, ranks) if t else ([], [])
        out, at = [], 0
        for a, b in gone:
            out += [t[at:a], mark]
            at = b
        return ("".join([*out, t[at:]]) if found else t), len(found)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text):
                done = [clean(t) for t in part.column(text).to_pylist()]
                columns = [pa.array([t for t, _ in done], pa.string()) if n == text else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in done], pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = find_secrets(docs, ranks=word_ranks(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = joined(F.filter("spans", lambda s: s["kind"] != "guess"))
    return out.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("guess").alias("n_guess"))
