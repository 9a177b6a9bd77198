import random
import re

from tracklane.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(make_docs, edges):
    rng = random.Random(3)
    texts = [(100 + i, "".join(rng.choice(["a", "b", "c ", " ", "\n", "d\t", "#", "é", "\x0b"]) for _ in range(rng.randint(0, 200)))) for i in range(150)]
    rows = edges + texts
    got = sorted(map(str, quality.judged(quality.measure(make_docs(rows))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()))
    expected = sorted(f"Row(doc_id={i}, n_words={n}, word_chars={c}, n_symbols={s}, n_dup_lines={d}, n_repeat_words={r}, base_failed={f})" for i, t in rows for n, c, s, d, r, f in [plain(t)])
    assert got == expected


def test_frequent_lines_are_removed_and_depleted_documents_rejected(make_docs):
    own = lambda i: " ".join(f"own{i}w{k}" for k in range(12))
    rows = [(i, f"Shared  LINE number 7 here\n{own(i)}", "host") for i in range(30)]
    rows += [(100 + i, f"{own(100 + i)}\n" + "only shared words in this one line of the host which is the same everywhere", "other") for i in range(5)]
    rows += [(200 + i, "only shared words in this one line which is the same everywhere at all\nx", "host") for i in range(25)]
    out = {r.doc_id: r for r in quality.judged(quality.measure(make_docs(rows)), min_docs=20).collect()}
    assert all(out[i].kept and out[i].removed_words == 5 for i in range(30))
    assert all(out[100 + i].kept and out[100 + i].removed_words == 0 for i in range(5))  # the same line, but rare on its host
    assert all(not out[200 + i].kept and not out[200 + i].base_failed for i in range(25))
    cleaned = {r.doc_id: r.text for r in quality.clean(make_docs(rows), min_docs=20).collect()}
    assert cleaned[3] == own(3) and 200 not in cleaned


def test_empty(make_docs):
    assert quality.judged(quality.measure(make_docs([]))).count() == 0


def test_the_limit_does_not_grow_with_the_host(spark, make_docs):
    """21 documents with one line, on a host of 25,000 and on one of 21; 20 stay on either."""
    own = lambda i: " ".join(f"{i}w{k}".translate(dict(zip(b"0123456789", "abcdefghij"))) for k in range(12))
    shared = lambda name, n, start, host: [(start + i, f"one line that {name} repeats\n{own(start + i)}", host) for i in range(n)]
    rows = shared("often", 21, 0, "large") + shared("seldom", 20, 100, "large") + shared("small", 21, 200, "small")
    many = spark.range(1000, 26_000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 12), k -> translate(concat('w', id, 'x', k), '0123456789', 'abcdefghij'))) AS text", "'en' AS lang", "'large' AS source", "5L AS n_chars")
    docs = make_docs(rows, extra=False).unionByName(many)
    out = {r.doc_id: r.removed_words for r in quality.judged(quality.measure(docs)).where("doc_id < 1000").collect()}
    assert out == {i: 5 for i in range(21)} | {100 + i: 0 for i in range(20)} | {200 + i: 5 for i in range(21)}
