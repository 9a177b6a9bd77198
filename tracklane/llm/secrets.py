"""Secret scans: pattern spans, and values in credential contexts by their guess cost.

Whole texts are scanned without a shuffle. Three patterns give the base
spans. A value in a credential context (password, token, auth, private key, ...)
is split at minimum cost into words, dates, repeats, keyboard walks and
brute-force spans; it is a secret if guessing it costs enough, and adds a span
where no base span covers it whole. Words are COMMON_WORDS, the words of a
public tokenizer's vocabulary where its path is given, and the words that the
corpus itself uses in many documents (corpus_words), in whatever language.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import bounded_batches, tidied

KINDS = ("assign", "access", "hex", "credential")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# A quoted value goes to its closing quote on the line; any other to white space, a quote or a bracket, and to a comma or semicolon at its end or before another key.
_SCHEME = r"(?:(?:bearer|basic|token)[\x20\t]{1,4})?+"
CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|auth(?:orization)?|bearer|credentials?|(?:client|app)_?secret|(?:private|access|signing|encryption)_?key)|password|passwd|secret|token|api[_-]?key)["']?[\x20\t]{0,4}(?:=>|[:=])[\x20\t]{0,4}"""
    rf"""(?:(["']){_SCHEME}((?:\\[^\n]|(?!\1)[^\n\\]){{6,}})\1|["']?{_SCHEME}((?:[^\s"'<>,;]|(?<![\s,;])[,;](?![\s"'<>,;]|$|[\w.-]{{1,40}}[\x20\t]{{0,4}}[:=])){{6,}}))""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_HINTS = ("pass", "pwd", "auth", "bearer", "credential", "secret", "token", "key")

#: log10 of the guesses from which a value in a credential context is a secret.
MIN_GUESSES_LOG10 = 8.0

# Frequent parts of passwords, most frequent first.
COMMON_WORDS = (
    "password", "admin", "welcome", "login", "master", "secret", "dragon", "monkey", "letmein", "love",
    "sunshine", "princess", "football", "baseball", "shadow", "superman", "batman", "michael", "jordan", "daniel",
    "test", "user", "root", "guest", "default", "changeme", "example", "sample", "demo", "hello",
    "summer", "winter", "spring", "autumn", "january", "february", "march", "april", "june", "july",
    "august", "september", "october", "november", "december", "monday", "friday", "sunday", "company", "server",
    "system", "manager", "office", "access", "account", "service", "public", "private", "database", "network",
    "computer", "internet", "google", "windows", "linux", "oracle", "mysql", "cisco", "temp", "pass",
    "word", "your", "the", "and", "here", "none", "null", "true", "false", "value",
    "string", "enter", "token", "key", "name", "cat", "dog", "blue", "red", "green",
    "black", "white", "star", "king", "queen", "angel", "happy", "lucky", "money", "magic",
)
#: Documents that a word of the corpus has to be in, and the most such words that tasks are sent (most frequent first).
MIN_DOCS, MOST_CORPUS_WORDS = 20, 1 << 17
#: Words that a task counts before it sends their counts on.
HELD_WORDS = 100_000
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "0123456789")

_WORD_COST = {w: math.log10(2.0 + rank) for rank, w in enumerate(COMMON_WORDS)}
_NEIGHBOURS = {p for row in KEY_ROWS for p in (*zip(row, row[1:]), *zip(row[1:], row))}
_DATE = re.compile(r"(?:19|20)\d\d|(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
_DATE_LENGTHS = (4, 8, 10)
_DATE_COST = {4: math.log10(200), 8: math.log10(200 * 365), 10: math.log10(200 * 365 * 3)}
_WALK_START = math.log10(len(set("".join(KEY_ROWS))) * 2)
#: Every further segment doubles the guesses: where it starts has to be guessed too.
_JOINT = math.log10(2)
_LONGEST_REPEATED = 8
#: Lengths of walks and numbers of repeats that are tried one by one; beyond, only the whole run.
MOST_STEPS = 64
#: Lengths of words that are taken from a vocabulary.
LEAST_WORD, MOST_WORD = 3, 24


def _brute(ch: str) -> float:
    return 1.0 if ch.isdigit() else math.log10(26) if ch.isalpha() else math.log10(33)


class Words:
    """log10 of the guesses of each word, and the longest word's length."""

    def __init__(self, costs: dict[str, float]) -> None:
        self.costs, self.longest = costs, max(map(len, costs))


@lru_cache(maxsize=4)
def known_words(vocabulary: str | None = None) -> Words:
    """COMMON_WORDS, then the whole words of a tokenizer file (a JSON vocabulary in order of its merges), by rank."""
    costs = dict(_WORD_COST)
    if vocabulary:
        entries = json.loads(Path(vocabulary).read_text())["model"]["vocab"]
        for token, _ in sorted(entries.items(), key=lambda x: x[1]):
            word = token.removesuffix("</w>")
            if word != token and word.isalpha() and LEAST_WORD <= len(word) <= MOST_WORD:
                costs.setdefault(word, math.log10(2.0 + len(costs)))
    return Words(costs)


_PROSE = re.compile(r"(?<!\w)[^\W\d_]{%d,%d}(?!\w)" % (LEAST_WORD, MOST_WORD))


def prose_words(text: str) -> set[str]:
    """Words of a text, in lower case, that stand outside credential contexts and access keys: a leaked value is no word, however often it is copied."""
    low = text.lower()
    if any(h in low for h in CONTEXT_HINTS):
        text = CONTEXT.sub(" ", text)
    if "AKIA" in text:
        text = ACCESS.sub(" ", text)
    return {m[0] for m in _PROSE.finditer(text.lower())}


def corpus_words(docs: DataFrame, min_docs: int = MIN_DOCS, most: int = MOST_CORPUS_WORDS) -> list[str]:
    """Words that at least min_docs rows of docs use in their prose, by number of rows, then by code points; most of them at most.

    Counts cover all rows and whole texts; tasks count up to HELD_WORDS words before they send them on.
    Null and empty texts have no words, repeated rows count each, an empty table
    gives an empty list. What reaches the driver is bounded by most * MOST_WORD
    characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "docs"])

        counts: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0):
                counts.update(prose_words(value.as_py() or ""))
                if len(counts) >= HELD_WORDS:
                    yield block()
                    counts.clear()
        yield block()

    counted = bounded_batches(docs.select("text")).mapInArrow(tidied(run), "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    return [r.word for r in counted.where(F.col("docs") >= min_docs).orderBy(F.desc("docs"), "word").limit(most).collect()]


def ranked_words(vocabulary: str | None, ranked: Sequence[str] = ()) -> Words:
    """known_words, and words by rank as corpus_words gives them; a word of both costs the less of the two."""
    known = known_words(vocabulary)
    if not ranked:
        return known
    costs = dict(known.costs)
    for rank, word in enumerate(ranked):
        cost = math.log10(2.0 + rank)
        if cost < costs.get(word, math.inf):
            costs[word] = cost
    return Words(costs)


def guess_cost(value: str, words: Words | None = None) -> float:
    """log10 of the guesses for value: the least cost over its segmentations.

    A walk or a repeat ends at any place and takes any of its last MOST_STEPS
    lengths, or the whole run; time is linear in the value's length.
    """
    words = words or known_words()
    known = words.costs
    low, n = value.lower(), len(value)
    if len(low) != n:  # letters that grow in lower case
        low = value
    cased = [0.0]  # upper-case letters double the guesses of a word
    chars = [0.0]
    for ch in value:
        cased.append(cased[-1] + (_JOINT if ch.isupper() else 0.0))
        chars.append(chars[-1] + _brute(ch))
    walk, periodic = 1, [0] * (_LONGEST_REPEATED + 1)
    token, brute = [0.0] + [math.inf] * n, [0.0] + [math.inf] * n  # best costs by kind of the last segment
    for i in range(1, n + 1):
        brute[i] = min(brute[i - 1] if i > 1 else 0.0, token[i - 1] + _JOINT * (i > 1)) + chars[i] - chars[i - 1]
        best = math.inf

        def after(start: int, cost: float) -> float:
            return min(token[start], brute[start]) + cost + _JOINT * (start > 0)

        for k in range(2, min(words.longest, i) + 1):
            if (cost := known.get(low[i - k : i])) is not None:
                best = min(best, after(i - k, cost + cased[i] - cased[i - k]))
        for k in _DATE_LENGTHS:
            if k <= i and _DATE.fullmatch(low, i - k, i):
                best = min(best, after(i - k, _DATE_COST[k]))
        walk = walk + 1 if i > 1 and (low[i - 2], low[i - 1]) in _NEIGHBOURS else 1
        for k in {*range(3, min(walk, MOST_STEPS) + 1), walk} if walk >= 3 else ():
            best = min(best, after(i - k, _WALK_START + math.log10(k) + cased[i] - cased[i - k]))
        for p in range(1, min(_LONGEST_REPEATED, i - 1) + 1):
            periodic[p] = periodic[p] + 1 if low[i - 1] == low[i - 1 - p] else 0
            most, least = periodic[p] // p + 1, 3 if p == 1 else 2
            for times in {*range(least, min(most, MOST_STEPS) + 1), most} if most >= least else ():
                start = i - times * p
                best = min(best, after(start, chars[start + p] - chars[start] + math.log10(times)))
        token[i] = best
    return min(token[n], brute[n])


def find_spans(text: str, words: Words | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    """All spans (start, kind, end) in order, kinds as indices of KINDS, and the values of all credential contexts: (start, end, guess cost)."""
    spans, low, values = [], text.lower(), []
    if any(h in low for h in ASSIGN_HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(h in low for h in CONTEXT_HINTS):
        base = sorted(spans)
        for m in CONTEXT.finditer(text):
            start, end = m.span(2 if m[2] else 3)
            cost = guess_cost(text[start:end], words)
            values.append((start, end, cost))
            if cost >= MIN_GUESSES_LOG10 and not any(s <= m.start() and end <= e for s, _, e in base):
                spans.append((m.start(), 3, end))
    return sorted(spans), values


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def verdicts(values: list[tuple[int, int, float]]) -> str:
    return ",".join(f"{s}:{e}:{cost:.2f}:{'secret' if cost >= MIN_GUESSES_LOG10 else 'weak'}" for s, e, cost in values)


def scan(docs: DataFrame, vocabulary: str | None = None, ranked: Sequence[str] = ()) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_credential, base_sha256, spans, guess_log10 (highest cost in a context), values.

    values: start:end:log10 of guesses:verdict of the value in each credential
    context, base spans' too. Offsets are code points, ends exclusive. Null and
    empty texts have no spans. A null doc_id stays null; repeated rows are
    scanned each on its own; other columns are not touched. ranked: corpus_words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tuple(ranked))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ranked_words(vocabulary, sent.value)
        for batch in batches:
            counts, digests, spelled, costs, judged = [[], [], [], []], [], [], [], []
            for value in batch.column(1):
                spans, values = find_spans(value.as_py() or "", words)
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in spans))
                digests.append(hashlib.sha256(joined([x for x in spans if x[1] < 3]).encode()).hexdigest())
                spelled.append(joined(spans))
                costs.append(max((v[2] for v in values), default=0.0))
                judged.append(verdicts(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spelled, pa.string()), pa.array(costs, pa.float64()), pa.array(judged, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_credential", "base_sha256", "spans", "guess_log10", "values"],
            )

    schema = f"doc_id {id_type}, n_assign long, n_access long, n_hex long, n_credential long, base_sha256 string, spans string, guess_log10 double, values string"
    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(tidied(run), schema)


def hidden(text: str, mark: str = "[SECRET]", words: Words | None = None) -> str:
    """text with every run of overlapping spans replaced by mark."""
    out, at = [], 0
    end = -1
    for s, _, e in find_spans(text, words)[0]:
        if s < end:
            end = max(end, e)
            continue
        if end >= 0:
            at = end
        out.append(text[at:s] + mark)
        end = e
    return "".join(out) + text[max(end, 0) :]


def redact(docs: DataFrame, length_col: str | None = "n_chars", vocabulary: str | None = None, ranked: Sequence[str] = ()) -> DataFrame:
    """docs with secrets in `text` replaced; other columns as they are, but length_col, if present, follows the text. Null texts stay null. ranked: corpus_words."""
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(tuple(ranked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ranked_words(vocabulary, sent.value)
        for batch in batches:
            texts = [None if v is None else hidden(v, words=words) for v in batch.column(names.index("text")).to_pylist()]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(texts, pa.string())
            if length_col in names:
                columns[names.index(length_col)] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(length_col).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return bounded_batches(docs).mapInArrow(tidied(run), docs.schema)
