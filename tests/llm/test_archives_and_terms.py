"""WARC archives, source divergence and ranked search against plain versions of the same rules."""

from __future__ import annotations

import collections
import glob
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampliq.llm import lexical, warc
from ampliq.llm.divergence import share, source_divergence, term_counts
from ampliq.llm.lexical import ranked_search
from ampliq.llm.warc import read_warc, write_warc


@pytest.fixture
def small_splits(spark):
    """Sets how many bytes of a file a task reads, and puts the old number back."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {n: spark.conf.get(n) for n in names}

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield use
    for n, value in old.items():
        spark.conf.set(n, value)


def _record(payload: bytes, kind: str = "response", length: int | None = None) -> bytes:
    return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: "
            f"{len(payload) if length is None else length}\r\n\r\n").encode() + payload + b"\r\n\r\n"


def _read_plainly(data: bytes) -> list[tuple[int, bytes, bytes]]:
    """Records by following lengths from the start of the file: offset, header, block."""
    at, found = 0, []
    while data[at : at + 10] == b"WARC/1.1\r\n" and (end := data.find(b"\r\n\r\n", at + 10)) >= 0:
        head = data[at + 10 : end]
        length = int(re.search(rb"(?im)^content-length: *([0-9]+)", head).group(1))
        if end + 4 + length > len(data):
            break
        found.append((at, head, data[end + 4 : end + 4 + length]))
        at = end + 4 + length + 4
    return found


ROWS = [
    (1, "http://a.example/x", "x" * 120), (2, "http://a.example/y", "x" * 120), (3, None, "y" * 99), (4, "u\r\nWARC-Type: revisit", "y" * 99),
    (5, "", None), (6, "http://b/", ""), (None, "http://n/", "x" * 120), (2, "http://a.example/y", "x" * 120), (1, "again", "x" * 120),
    # Payloads that hold marks: bare, with a header, a whole record, a whole archive, one that claims to end with the record.
    (10, "m", "about WARC/1.1\r\nand more"), (11, "m", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc"),
    (12, "m", _record(b"inner payload").decode()), (13, "m", "".join(_record(f"inner {i}".encode() * 9).decode() for i in range(40))),
    (14, "m", "WARC/1.1\r\nContent-Length: 4\r\n\r\n"), (15, "m", "é" * 80 + "WARC/1.1\r\n" + "日本" * 70 + "WARC/1.1\r\n"),
    (16, "m", _record(b"k" * 70, length=70 + 300).decode() + "tail " * 100), (17, "\x00 \x7f", "z" * 3_000), (18, "l", "\r\n\r\n" * 50),
]
EXTRA = "page_id long, url string, html string, id string, body string, digest string, block string, n string"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "i", "b", "d", "k", "n") for r in rows], EXTRA)


@pytest.mark.parametrize("split, with_payload", [(1 << 27, False), (1_500, True), (333, False)])
def test_archives_read_back_at_any_split(spark, tmp_path, small_splits, split, with_payload):
    path = str(tmp_path / "w")
    write_warc(_pages(spark, ROWS).repartition(2, "page_id"), path)
    plain = {}
    for file in glob.glob(path + "/*.txt"):
        for at, head, block in _read_plainly(open(file, "rb").read()):
            plain[file.rsplit("/", 1)[1], at] = (head, block.split(b"\r\n\r\n", 1)[1])
    assert len(plain) == len(ROWS)
    small_splits(split)
    rows = read_warc(spark, path, with_payload).collect()
    assert {(r.file.rsplit("/", 1)[1], r.offset) for r in rows} == set(plain) and len(rows) == len(plain)
    want = collections.Counter()
    for page_id, _, html in ROWS:
        body = (html or "").encode()
        repeats = [r[0] for r in ROWS if r[2] == html and r[0] is not None]
        again = len(body) >= 100 and page_id != min(repeats, default=page_id)
        want[str(page_id) if page_id is not None else "", len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", str(min(repeats)) if again else None] += 1
    assert collections.Counter((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    assert all(r.intact for r in rows if r.record_type == "response")
    for r in rows:
        if with_payload:
            assert bytes(r.payload) == plain[r.file.rsplit("/", 1)[1], r.offset][1]
        else:
            assert r.payload is None


@pytest.mark.parametrize("split", [400, 1 << 27])
def test_archives_of_other_origin(spark, tmp_path, small_splits, split):
    """Other content types, garbage after a record, a file cut short, one without marks, and an empty one."""
    whole = b"".join(_record(bytes([65 + i]) * (i * 7)) for i in range(20))
    for name, data in {"a": whole, "b": whole[:300], "c": whole + b"garbage" + whole, "d": b"no archive", "e": b"", "f": b"x" + whole}.items():
        (tmp_path / name).write_bytes(data)
    small_splits(split)
    rows = read_warc(spark, str(tmp_path), True).collect()
    for name in "abcdef":
        plain = _read_plainly((tmp_path / name).read_bytes())
        got = sorted((r.offset, bytes(r.payload)) for r in rows if r.file.endswith("/" + name))
        assert got == [(at, block) for at, _, block in plain]
    assert all(r.intact is None for r in rows)


def test_chain_intervals():
    """Intervals hold a candidate's first number exactly where its chain runs through."""
    rng = random.Random(5)
    for _ in range(40):
        starts = np.array(sorted(rng.sample(range(0, 600), 30)))
        successors = np.array([rng.choice([*(s for s in starts if s > a), a + 3, 1000 + rng.randrange(9)]) for a in starts])
        leaves, first, after = warc._chains(starts, successors, 900)
        place = {int(s): i for i, s in enumerate(starts)}
        for i in range(30):
            run, at = {i}, i
            while int(successors[at]) in place:
                at = place[int(successors[at])]
                run.add(at)
            assert leaves[i] == (successors[at] if successors[at] >= 890 else -1)
            assert {j for j in range(30) if first[j] <= first[i] < after[j]} == run


def test_no_pages(spark, tmp_path):
    write_warc(_pages(spark, ROWS).limit(0), str(tmp_path / "w"))
    assert read_warc(spark, str(tmp_path / "w")).count() == 0


LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SIGNS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(pattern, text):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def _divergence(rows, least, top):
    """The audit by plain loops and Python's whole numbers."""
    of = collections.defaultdict(collections.Counter)
    held = collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        terms = _terms(LETTERS, text)
        of[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = set()
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = sorted(s for la, s in of if la == lang)
        shares = lambda n: [1 + 10**9 * (n[t] + 2) // (sum(n[x] for x in kept) + 2 * len(kept)) for t in kept]
        p = {s: shares(of[lang, s]) for s in sources}
        whole = shares(sum((of[lang, s] for s in sources), collections.Counter()))
        for s in sources:
            pairs = sorted(((-sum(map(f, p[s], p[o])), o.encode(), o) for o in sources if o != s))
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)}
            more = sorted((-f(a, q), t.encode(), t) for t, a, q in zip(kept, p[s], whole) if of[lang, s][t] > 0 and a > q)
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(more[:top])}
    return out


def _corpus(seed=3):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma-delta", "été", "ÉTÉ", "x1y", "日本", "z", "ein_wort", "zeta", "eta", "theta"]
    rows = []
    for i in range(120):
        lang, source = rng.choice(["a", "b", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", None, "é"])
        rows.append((lang, source, " ".join(rng.choices(words, [12 - j for j in range(12)], k=rng.randrange(0, 30)))))
    rows += [("c", "only", "too few documents"), ("c", "other", None), ("a", "blank", " \n "), ("a", None, "alpha " * 5000), ("d", None, "")]
    return rows + rows[:20]


@pytest.mark.parametrize("block, rows", [(500_000, 1_024), (7, 2)])
def test_divergence_against_plain_loops(spark, block, rows):
    corpus = _corpus()
    df = spark.createDataFrame([(*r, "t", "i", 5) for r in corpus], "lang string, source string, text string, term string, idx string, n long")
    got = source_divergence(df.repartition(5), 6, 4, block, rows).collect()
    assert {tuple(r) for r in got} == _divergence(corpus, 6, 4) and len({tuple(r) for r in got}) == len(got)


def test_divergence_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert source_divergence(df).count() == 0


def test_term_counts_given_out_early(spark):
    """A table that is given out after every few entries makes the same sums."""
    df = spark.createDataFrame(_corpus(), "lang string, source string, text string")
    once, often = ({tuple(r) for r in term_counts(df, most, size).collect()} for most, size in ((10**6, 10**9), (3, 50)))
    assert once == often


def test_shares_are_exact():
    for total in (7, 10**6, 10**12 + 7, 2**62):
        counts = np.array([0, 1, 5, total // 3, total - 2])
        counts = counts[counts + 2 <= total]
        assert share(counts, np.full(len(counts), total)).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts]


def _search(docs, items, k):
    listed = [(doc_id, collections.Counter(_terms(SIGNS, text)), len(_terms(SIGNS, text))) for doc_id, text in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in listed), sum(n for *_, n in listed)
    df = collections.Counter(t for _, c, _ in listed for t in c)
    asked = collections.defaultdict(list)
    for item, text in set(items):
        asked[item] += _terms(SIGNS, text)
    out = []
    for item, terms in asked.items():
        scored = []
        for doc_id, c, n in listed:
            m = 75 + 25 * n * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored)[:k])]
    return collections.Counter(out)


def _searchable(seed=9):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "the", "THE", "a_b", "日本"]
    weights = [1 + 40 / (i + 1) for i in range(65)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 40, 90])))) for i in range(150)]
    docs += [(None, "w3 w4 the"), (None, "w3 w4 the"), (400, None), (401, "  "), (402, "w7 " * 20_000)]
    docs += [(500 + i, "w1 w2 copies of one text") for i in range(45)] + [(7, "w1 w2 w50")] * 3
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 12)))) for i in range(20)]
    return docs, items + items[:3] + [(2, "w1 w1 w59"), (None, "w5 the"), (90, None), (91, "unheard of"), (92, "w1 w2 copies of one text")]


@pytest.mark.parametrize("owners, segment, bundle", [(4, 8_192, 256), (3, 7, 4), (1, 50, 1)])
def test_search_against_plain_scores(spark, owners, segment, bundle):
    docs, items = _searchable()
    df = spark.createDataFrame([(*r, "t", 1, "s") for r in docs], "doc_id long, text string, term string, segment long, ids string")
    asked = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, item string")
    got = ranked_search(df.repartition(3), asked, 20, owners, segment, bundle).collect()
    assert collections.Counter(map(tuple, got)) == _search(docs, items, 20)


def test_search_with_more_terms_than_tasks_are_given(spark, monkeypatch):
    monkeypatch.setattr(lexical, "_GIVEN_TERMS", 0)
    docs, items = _searchable(4)
    got = ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 20, 2, 20).collect()
    assert collections.Counter(map(tuple, got)) == _search(docs, items, 20)


def test_search_in_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search(docs, items).count() == 0
    assert ranked_search(items.toDF("doc_id", "text"), items.limit(0)).count() == 0


def test_norms_of_great_collections():
    lengths = np.array([1, 10**9])
    assert lexical.measure(lengths, 10**11, 10**14).tolist() == [75 + 25 * n * 10**11 // 10**14 for n in (1, 10**9)]
