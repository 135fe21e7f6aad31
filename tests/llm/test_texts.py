import random

import numpy as np
import pytest

from graphloom.llm import leakage, mixing, truncation

WORDS = [a + b for a in ("ra", "lo", "mi", "te", "su", "ko", "ve", "na") for b in ("bel", "dor", "fin", "gat", "hum", "jak", "lit", "mox")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- leakage -----------------------------------------------------------------


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = base.copy()
    for i in range(400):
        for b in rng.choice(64, i % 6, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    a, b = leakage.HammingIndex(base).search(near)
    want = {(int(i), int(j)) for i in range(400) for j in np.flatnonzero(np.bitwise_count(base ^ near[i]) <= leakage.RADIUS)}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_windows_are_the_same_in_any_place():
    rng = random.Random(1)
    hashes = leakage.hashes_of(leakage.words_of(text(rng, 60)))
    weights = leakage.Weights([hashes])
    all_of, part = leakage.fingerprints(hashes, weights), leakage.fingerprints(hashes[10:50], weights)
    for size in leakage.SIZES:
        assert len(all_of[size]) == 61 - size and (all_of[size][10 : 51 - size] == part[size]).all()
    assert all(len(p) == 0 for p in leakage.fingerprints(hashes[:3], weights).values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_of_fingerprints(sf):
    """Of changed items and parts that hold the share by brute force, fingerprints within the radius find nine tenths and more; equal ones find fewer."""
    import pyarrow.parquet as pq

    rng = random.Random(9)
    items = [(r["item_id"], r["item_text"]) for r in pq.read_table(f"/root/testdata/{sf}/eval_items.parquet").to_pylist()]
    docs = [leakage.words_of(r["text"]) for r in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).to_pylist()]
    docs = [d for d in docs if len(d) > 20]
    other = [w for d in docs for w in d]
    blocks = [leakage.Block(items, radius) for radius in (0, leakage.RADIUS)]
    whole, found, cases = blocks[1], {}, {}
    for every in (4, 5, 6, 7, None):
        for n, item in enumerate(whole.items):
            words = list(item.words)
            if every is None or n % 2:  # two fifths of it, or half with changes
                length = -(-len(words) * (2 if every is None else 3) // 5) + 1
                start = rng.randrange(len(words) - length + 1)
                words = words[start : start + length]
            if every:
                words = [rng.choice(other) if (at + n) % every == 0 else w for at, w in enumerate(words)]
            doc = rng.choice(docs)
            at = rng.randrange(len(doc))
            doc = doc[:at] + words + doc[at:]
            if item.share_in(doc) < leakage.SHARE:
                continue
            cases[every] = cases.get(every, 0) + 1
            hashes, owner = leakage.hashes_of(doc), np.zeros(len(doc), dtype=np.int64)
            for b in blocks:
                found[b, every] = found.get((b, every), 0) + (n in b.near(hashes, owner).tolist())
    for every, many in cases.items():
        assert many > 30 and found[whole, every] >= 0.95 * many, every
    assert sum(found[blocks[0], e] for e in cases) < sum(found[whole, e] for e in cases)


def test_leaks(spark):
    rng = random.Random(7)
    items = [(i, text(rng, 50)) for i in range(30)] + [(90, None), (91, " .. "), (92, "tiny item"), (93, "")]
    docs = [(d, text(rng, 120)) for d in range(200)]

    def put(d, piece):
        words = docs[d][1].split()
        docs[d] = (d, " ".join([*words[:40], piece, *words[40:]]))

    want = set()
    for n in range(20):
        words = items[n][1].split()
        length = 50 if n % 2 else 26  # whole, or a bit over two fifths
        part = words[10 : 10 + length] if length < 50 else list(words)
        for at in range(8, len(part) - 4, 13):  # scattered changes
            part[at] = "zzz"
        piece = " ".join(part)
        piece = [piece.upper(), "\n# ".join(piece.split(" ")), piece.replace(" ", ", "), "<b>" + piece + "</b>"][n % 4]
        put(n, piece)
        want.add((n, n))
    put(50, " ".join(items[25][1].split()[:12]))  # too little
    put(51, " ".join(reversed(items[26][1].split())))  # not in order
    put(52, "has a Tiny, item inside")
    want.add((52, 92))
    rows = [*docs, (300, None), (301, ""), (0, docs[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = leakage.find_leaks(df, spark.createDataFrame(items, "item_id bigint, item_text string"))
    pairs = [(r.doc_id, r.item_id) for r in got.collect()]
    assert set(pairs) == want and pairs.count((0, 0)) == 2
    assert leakage.find_leaks(df, spark.createDataFrame([], "item_id bigint, item_text string")).count() == 0
    assert leakage.find_leaks(df.limit(0), spark.createDataFrame(items, "item_id bigint, item_text string")).count() == 0


def test_common_words():
    assert leakage.common_words(list("abcde"), list("xbydz")) == 2 and leakage.common_words([], ["a"]) == 0


def brute_share(item, doc):
    """Best chain over all words in common, each held against each (stretches of words at most two apart, chained within the bounds)."""
    k = {1: 1, 2: 2, 3: 2}.get(len(item), 3)
    best = {}
    for q, word in enumerate(doc):
        for p in [p for p, w in enumerate(item) if w == word]:
            before = [(q - b, p - a, n, m) for (a, b, n), m in best.items() if a < p and b < q]
            for n in range(1, k + 1):
                if n == 1:
                    value = 1 + max([m for dq, dp, j, m in before if j == k and dq <= leakage.GAP + 1 and abs(dq - dp) <= leakage.SHIFT], default=0)
                if n > 1 or k == 1:
                    near = [m for dq, dp, j, m in before if dq <= 2 and dp <= 2 and (j == n - 1 or j == n == k)]
                    value = max([1 + m for m in near] + ([value] if n == 1 else []), default=0)
                if value:
                    best[p, q, n] = value
    return max((m for (_, _, n), m in best.items() if n == k), default=0) / len(item)


def test_stock_phrases_are_no_leak():
    rng = random.Random(3)
    noun = lambda: rng.choice(WORDS) + rng.choice(WORDS)
    phrase = lambda: rng.choice(["the {} of every {}", "one {} per {}", "and each {} of the {}", "any {} by its {}"]).format(noun(), noun())
    items = [(i, " ".join(phrase() for _ in range(9))) for i in range(60)]
    text = " ".join(w + "x" for w in items[7][1].split())
    variants = [(100 + i, f"{text} {WORDS[i]}") for i in range(12)] + [(200, text), (201, text)]
    block = leakage.Block(items + variants)
    docs = [" ".join(phrase() for _ in range(12)).split() for _ in range(20)] + [["start", *text.split(), "end"], ["start", *items[5][1].split(), "end"]]
    got = {(d, i) for d, i, _ in block.leaks(docs)}
    assert got == {(20, i) for i, _ in variants} | {(21, 5)}


def test_leaks_with_close_changes_against_brute_force():
    rng = random.Random(5)
    items = [(i, text(rng, rng.choice((1, 2, 3, 4, 5, 7, 24, 40)))) for i in range(40)]
    docs, planted = [], []
    for n in range(160):
        doc = text(rng, rng.choice((3, 30, 70))).split()
        item, words = items[n % 40]
        words, every = words.split(), 2 + n // 40 % 5
        if len(words) >= 24:
            words = [w if at % every else rng.choice(("zzz", "yyy xxx", "")) for at, w in enumerate(words)]
            planted += [(n, item)] if every > 2 else []
        elif len(words) > 2:  # short: one changed word
            words[rng.randrange(1, len(words))] = "zzz"
            planted += [(n, item)] if len(words) > 4 and words[2] != "zzz" else []
        at = rng.randrange(len(doc))
        docs.append(leakage.words_of(" ".join([*doc[:at], *words, *doc[at:]])))
    want = {}
    for d, doc in enumerate(docs):
        for i, words in items:
            if (share := brute_share(words.split(), doc)) >= leakage.SHARE - 1e-9:
                want[d, i] = share
    got = {(d, i): share for d, i, share in leakage.Block(items).leaks(docs)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(planted) > 40 and set(planted) <= set(got)


# --- mixing ---------------------------------------------------------------------


def test_shares_and_caps(spark):
    rng = random.Random(2)
    docs = [(i, "hot" if i % 3 else f"s{i % 2}", text(rng, rng.randrange(5, 60))) for i in range(900)] + [(2000, None, "x"), (2001, "other", "x y"), (2002, "hot", None), (None, "hot", "no id"), (2002, "hot", None)]
    targets = [("hot", 0.3, 1), ("s0", 0.4, 3), ("s1", 0.2, 2), ("gone", 0.1, 2), (None, 0.0, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix_sources(df, t)
    rows = {r.source: r for r in report.collect()}
    assert set(rows) == {"hot", "s0", "s1", "gone"} and rows["gone"].used_tokens == 0
    for s, share in (("hot", 0.3), ("s0", 0.4), ("s1", 0.2)):
        assert abs(rows[s].actual_share - share / 0.9) < 0.01
        assert rows[s].most_copies <= rows[s].max_repeats
        assert abs(rows[s].used_tokens - rows[s].budget) < 300
    assert {r.source for r in mixed.collect()} == {"hot", "s0", "s1"}
    # nested: a smaller total keeps a subset of the copies
    a = {(r.doc_id, r.source): r.copies for r in mixing.mix_sources(df, t, total=2000)[0].collect()}
    b = {(r.doc_id, r.source): r.copies for r in mixing.mix_sources(df, t, total=6000)[0].collect()}
    assert all(b.get(k, 0) >= v for k, v in a.items()) and sum(a.values()) < sum(b.values())
    # beyond the caps: everything as often as allowed
    full = {r.source: r for r in mixing.mix_sources(df, t, total=10**9)[1].collect()}
    assert all(full[s].used_tokens == full[s].available_tokens * full[s].max_repeats for s in ("hot", "s0", "s1"))
    assert mixing.mix_sources(df.limit(0), t)[0].count() == 0


def test_threshold_against_sorting(spark):
    sizes = [(i, "a", (i * 2654435761) % (1 << 60), 1 + i % 7) for i in range(3000)]
    df = spark.createDataFrame(sizes, "doc_id bigint, source string, h bigint, tokens bigint")
    plan = spark.createDataFrame([("a", 5000, 0, 12000)], "source string, rest bigint, passes bigint, have bigint")
    limit = mixing.thresholds(df, plan).first().threshold
    taken = sum(n for _, _, h, n in sizes if h < limit)
    assert abs(taken - 5000) <= 7


# --- truncation --------------------------------------------------------------------


@pytest.mark.parametrize(
    "value, form",
    [
        ("A sentence.", "complete"), ("A sentence that is cut in the middle of its wo", "cut"), ("Ends with dots of a cut se…", "cut"), ("A sentence.\n\nand so on ...", "complete"), ("Cut here [truncated]", "cut"), ("Broken Schl�", "cut"), ("Text.\n\n```\ncode()\n```", "complete"), ("Text.\n\n```\ncode(", "cut"),
        ("| a | b |\n|---|---|\n| c | 1 |", "complete"), ("| a | b |\n|---|---|\n| c | ", "cut"), ("Text.\n\nRefs: LIB-12", "complete"), ("Text.\n\nSee also: docs/a/b.md", "complete"), ("Text.\n\n-- \ndocs team", "complete"), ("Text.\n\n- read the page", "item"), ("docs: read the page", "item"), ("Text.\n\nLGTM", "closing"), ("Text.\n\n+1", "closing"), ("Text.\n\nBye :)", "complete"),
        ("", "complete"), (None, "complete"), ("   ", "complete"), ("An open `quo", "cut"),
    ],
)
def test_forms(value, form):
    assert truncation.ending(value)[0] == form


def test_code_forms():
    assert truncation.ending("def f():\n    return 1\n", "python", None)[0] == "code"
    assert truncation.ending("def f():\n    return (1", "python", None)[0] == "cut"
    assert truncation.ending("def f():\n    '''Words and", None, "code_py")[0] == "cut"
    assert truncation.ending("int f(void) {\n    retu", "c", None)[0] == "cut"


def test_longer_copies_against_brute_force(spark):
    rng = random.Random(4)
    values = {rng.choice("ab") * rng.randrange(1, 4) + "".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))) for _ in range(400)}
    rows = list(enumerate(sorted(values)))
    rng.shuffle(rows)
    got = {r.h for r in truncation.longer_copies(spark.createDataFrame(rows, "h bigint, value string"), partitions=7).collect()}
    assert got == {h for h, v in rows if any(w != v and w.startswith(v) for w in values)}


def test_documents(spark):
    base = ["The walker reads the page.", "We count the pages, then the walker stops.", "Each page has a walker; the pages wait."] * 4
    rows = [(i, t, "en", "wiki") for i, t in enumerate(base)]
    rows += [(100, "Text.\n\n- read the", "en", "wiki"), (101, "Text.\n\n- read the walker", "en", "wiki"), (102, "Text.\n\n- read the walk", None, None), (103, None, "en", "wiki"), (104, "", None, None), (105, "Then the walker", "en", None), (106, "Text.\n\n- read the pages of the walker\n- read the page", "en", "wiki"), (107, "Text.\n\n- read the pages", "en", "wiki"), (108, "Text.\n\n- read the walker", "en", "wiki")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    judged = truncation.judge_documents(df)
    got = {r.doc_id: r.truncated for r in judged.collect()}
    assert {k for k, v in got.items() if v} == {100, 102, 107} and len(got) == len(rows)
    rates = {r.source: (r.documents, r.truncated) for r in truncation.truncation_rates(judged).collect()}
    assert rates == {"wiki": (18, 2), None: (3, 1)}
    assert truncation.judge_documents(df.limit(0)).count() == 0


def test_closing_lines_are_learned(spark):
    rng = random.Random(12)
    body = lambda: " ".join(rng.choice(WORDS) for _ in range(30)).capitalize() + "."
    rows = [(i, f"{body()}\n\n{'LGTM' if i % 3 else 'Build 12' + str(i)}", "en", "wiki") for i in range(150)]
    rows += [(1000 + i, f"{body()}\n\n{' '.join(rng.choice(WORDS) for _ in range(3)).capitalize()}", "en", "wiki") for i in range(20)]
    rows += [(2000 + i, rows[-1][1], "en", "wiki") for i in range(30)]  # copies of one text don't make a closing
    judged = truncation.judge_documents(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    assert {r.doc_id for r in judged.collect() if r.truncated} == {r[0] for r in rows if r[0] >= 1000}


def test_every_way_of_longer_copies(spark):
    rng = random.Random(6)
    values = sorted({"".join(rng.choice(["a", "b.", " ", "\n", "\n c", "1"]) for _ in range(rng.randrange(1, 7))) for _ in range(500)})
    df = spark.createDataFrame(list(enumerate(values)), "h bigint, value string")
    for partitions in (1, 9):
        got = {r.h: (r.within_line, r.deeper, r.in_token) for r in truncation.longer_copies(df, partitions).collect()}
        want = {}
        for h, v in enumerate(values):
            ways = [truncation._ways(v, w[len(v) :]) for w in values if w != v and w.startswith(v)]
            if ways:
                want[h] = tuple(any(way) for way in zip(*ways))
        assert got == want


def test_longer_copies_decide(spark):
    base = ["The walker reads the page.", "We count the pages, then the walker stops."] * 4
    broken = "def f(:\n    pass\n\ndef g(page):\n    return wal"
    texts = [
        *base, "It needs version 3.", "It needs version 3.14 of the page.", "Now see foo.", "Now see foo.bar() of the page.", "We stop.", "We stop. Then we read the page.",  # 8 to 13
        "Text.\n\n- read it  ", "Text.\n\n- read it", "Text.\n\n- read it\n- stop it", "Text.\n\n- read it with the walker.",  # 14 to 17
        "It needs version 3. ...",  # 18
    ]
    rows = [(i, t, "en", "wiki") for i, t in enumerate(texts)] + [(50, broken, "python", None), (51, broken + "ker(page)\n", "python", None), (52, "def f(:\n    pass\n\nx = 1\n", "python", None)]
    judged = truncation.judge_documents(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    assert {r.doc_id for r in judged.collect() if r.truncated} == {8, 10, 14, 15, 18, 50}
