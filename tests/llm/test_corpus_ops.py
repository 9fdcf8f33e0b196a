"""Operators across documents, against brute force."""

import random
import re

import pytest

pytest.importorskip("tidemark.llm.queries")

from oracle import same  # noqa: E402

from tidemark.llm import chat, lines, minhash, queries  # noqa: E402

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def near_copies(seed=5):
    r = random.Random(seed)
    word = lambda: r.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + r.choice("123456789")
    out = [None, "", "   ", "one two", "ONE  two", "one two three four five", "a b c d e f g", "a b c d e f g"]
    for size in (8, 12, 60, 200):
        base = [word() for _ in range(size)]
        for k in range(12):
            mine = list(base)
            for _ in range(k % 5):
                mine[r.randrange(size)] = word()
            out.append(" ".join(mine))
        walk = list(base)  # a chain: each a small step from the last
        for k in range(8):
            walk[(k * 7) % size] = word()
            out.append(" ".join(walk))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    sets = []
    for t in texts:
        w = [x for x in BLANK.split(re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, percent).collect()}
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), find(i), find(i) == i)
    assert minhash.near_duplicates(docs.limit(0), percent).count() == 0


def test_sketch_estimates():
    import numpy as np

    r = np.random.default_rng(2)
    for n in (3, 40, 2000):
        both = r.integers(0, 2**63, n).astype(np.uint64)
        left, right = (np.unique(np.concatenate([both, r.integers(0, 2**63, max(1, n // 5)).astype(np.uint64)])) for _ in range(2))
        true = n / len(np.union1d(left, right))
        assert abs(minhash.estimate((minhash.sketch(left) == minhash.sketch(right)).sum()) - true) < 0.2


def one_edit(a, b):
    """Whether two word lists are at most one insertion, deletion or substitution apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :] if (k < len(a) or len(b) > len(a)) else True


def line_texts(seed=9):
    r = random.Random(seed)
    pool = ["alpha beta gamma delta epsilon zeta eta theta iota kappa".split(), "uno dos tres cuatro cinco seis siete ocho".split(), "a a a a b b b b c".split()]
    out = [None, "", "\n\n", "short line", "short line\nshort line", "  \nshort  line"]
    for _ in range(60):
        text = []
        for _ in range(r.randint(1, 5)):
            w = list(r.choice(pool))
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 1)] = [r.choice("ABCxyz")] * r.randint(0, 1)
            text.append(" ".join(w))
        out.append("\n".join(text))
    return out + out[-3:]


def test_line_dedup(spark):
    texts = line_texts()
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, k long")
    got = {r["doc_id"]: r for r in lines.dedup(docs).collect()}
    seen, words_seen, fuzzy = set(), [], 0
    for i, t in enumerate(texts):
        kept = []
        for line in (t or "").split("\n"):
            w = [x for x in BLANK.split(line.lower()) if x]
            near = len(w) >= 8 and any(one_edit(w, o) for o in words_seen)
            fuzzy += near and line not in seen
            if not w or line not in seen and not near:
                kept.append(line)
            if w:
                seen.add(line)
                if len(w) >= 8:
                    words_seen.append(w)
        assert got[i]["text"] == (None if t is None else "\n".join(kept)), (i, t, got[i])
    assert fuzzy > 20 and got[7]["k"] == 7
    assert lines.dedup(docs.limit(0)).count() == 0


def test_line_dedup_of_short_lines(spark):
    r = random.Random(3)
    bases = ["the anhely eran.", "dos tres  cuatro", "a b c d e f g h", "漢字かな交じり文です", "x", "ab", "abcdefgh", "one two three four five six seven", "x" * 300]
    rows = ["the anhely eran.\nthe, anhely eran.", "The  anhely\tERAN.", "a b c d e f gh", "1.\n2.", "Yes\nYES\n yes", "abcdefg"]
    for _ in range(150):
        s = list(r.choice(bases))
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(s) + 1)
            s[k : k + r.randint(0, 1)] = r.choice(["", "Z", " ", "漢", "q"])
        rows.append("".join(s))
    got = {x["doc_id"]: x["text"] for x in lines.dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), short=True).collect()}
    earlier, fuzzy = [], 0
    for i, text in enumerate(rows):
        kept = []
        for line in text.split("\n"):
            w = [x for x in BLANK.split(line.lower()) if x]
            s = " ".join(w)
            near = any(
                line == o or len(w) <= 8 and len(v) <= 8 and (s == " ".join(v) or max(len(s), len(" ".join(v))) >= 8 and one_edit(s, " ".join(v))) or len(w) >= 8 and len(v) >= 8 and one_edit(w, v)
                for o, v in earlier
            )
            if not w or not near:
                kept.append(line)
            fuzzy += near and all(line != o for o, _ in earlier)
            if w:
                earlier.append((line, w))
        assert got[i] == "\n".join(kept), (i, text, got[i])
    assert fuzzy > 20 and got[0] == "the anhely eran." and got[1] == "" and got[3] == "1.\n2." and got[4] == "Yes"


def test_chat(spark):
    r = random.Random(4)
    full = [[(("user", "assistant")[k % 2], r.choice(["hi", None, "漢", "x" * 5000, ""])) for k in range(r.randint(1, 6))] for _ in range(25)]
    convs = full + [c[: r.randint(1, len(c))] for c in full] + full[:5]
    r.shuffle(convs)
    rows = [(i, 3 * k, role, text, "z") for i, c in enumerate(convs) for k, (role, text) in enumerate(c)] + [(None, 0, "user", "lost", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chat string")
    parts = {tuple(c[:k]) for c in convs for k in range(1, len(c))}
    want = {}
    for i, c in enumerate(convs):
        if tuple(c) not in parts:
            want.setdefault(tuple(c), []).append(i)
    kept = chat.collapse(turns)
    got = {x["conv_id"]: x for x in chat.render(turns, kept).collect()}
    assert {min(v): len(v) for v in want.values()} == {i: x["n_copies"] for i, x in got.items()}
    for c, v in want.items():
        assert got[min(v)]["chat"] == "".join(f"<|{a}|>\n{b or ''}<|end|>\n" for a, b in c)
    long = [(1, k, "user", str(k % 7)) for k in range(3000)] + [(2, k, "user", str(k % 7)) for k in range(2500)]
    assert [x["conv_id"] for x in chat.collapse(spark.createDataFrame(long, "conv_id long, turn long, role string, text string")).collect()] == [1]
    assert chat.collapse(turns.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    assert same(spark, queries.QUERIES[name], queries.ORACLES[name]) > 0


def test_pipeline_keys_rows_not_ids(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    passage = spark.read.parquet(f"{d}/benchmark.parquet").first()["text"]
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(2, a, "x"), (2, a, "x"), (3, b, "x"), (3, a, "x"), (None, c, "x"), (None, c, "y"), (None, b, "x"), (None, passage, "x"), (1, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    near = pipeline.near_dedup(spark, docs, d).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in near) == sorted([(2, a), (3, b), (0, c), (0, passage), (1, "")])
    clean = pipeline.decontamination(spark, docs, d)
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == sorted(map(str, docs.where(f"text is null or text <> '{passage}'").collect()))


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols, n = docs.columns, docs.count()
    from tidemark.llm.common import written

    for name, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, d), "test")
        assert docs.columns == cols, name
        assert 0 < docs.count() <= n
        n = docs.count()
    last = pipeline.STAGES[-1][1](spark, docs, d)
    assert last.count() == n and {"doc_id", "ids", "n_tokens"} <= set(last.columns)
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert not any(i in " ".join((r["text"] or "").lower().split()) for r in docs.collect() for i in items)


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_duplicates_by_cells(spark, monkeypatch, rounds):
    """Many texts about the threshold in shared bands, dealt into small cells: components equal those of all exact links."""
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    r = random.Random(8)
    base, texts = [f"w{i}" for i in range(150)], []
    for k in range(140):
        mine = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5])):
            mine[r.randrange(150)] = f"x{r.randrange(9999)}"
        texts.append(" ".join(mine))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{t.split()[i : i + 5].__str__() for i in range(146)} for t in texts]
    links = {i: {j for j, b in enumerate(sets) if 100 * len(a & b) >= 80 * len(a | b)} for i, a in enumerate(sets)}
    least = list(range(len(texts)))
    for _ in texts:
        least = [min(least[j] for j in links[i]) for i in range(len(texts))]
    assert {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs, 80).collect()} == dict(enumerate(least))
    assert 1 < len(set(least)) < 140


def test_meeting_by_bits_and_by_search():
    import numpy as np

    r = np.random.default_rng(1)
    own = [np.unique(r.integers(0, 300, 120)).astype(np.uint64) for _ in range(9)]
    others = np.array([0, 1, 3, 4, 5, 6, 7, 8])
    want = [len(np.intersect1d(own[2], own[j])) for j in others]
    assert list(minhash._meeting(own, 1)(2, others)) == list(minhash._meeting(own, 100)(2, others)) == want


def test_clashing_columns_and_empty_tables(spark):
    """Columns of the caller's that are named like those the operators and stages add on the way."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tidemark.llm import decontaminate, quality

    names = "_k _id _key _gone _lines _n _h _p _g _q _bad _row _at _doc row doc at gone k n_dropped lang source".split()
    long = " ".join(f"w{i}" for i in range(80)) + "."
    rows = [(1, f"{long}\nsame line here", *"a" * len(names)), (2, "same line here", *"b" * len(names)), (2, "same line here", *"b" * len(names)), (None, None, *"c" * len(names)), (3, "", *"d" * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = lines.dedup(docs, short=True)
    assert sorted(got.columns) == sorted(docs.columns) and sorted(r["_gone"] for r in got.collect()) == list("abbcd")
    assert sorted((r["doc_id"] or 0, r["text"], r["n_dropped"]) for r in got.collect() if r["text"] is not None) == [(1, f"{long}\nsame line here", 0), (2, "", 1), (2, "", 1), (3, "", 0)]
    assert {c: r for c, r in quality.features(docs).where("doc_id = 1").first().asDict().items() if c in names and c != "_q"} == {n: "a" for n in names if n != "_q"}
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    left = decontaminate.clean(docs.where("doc_id is not null"), bench)
    assert left.columns == docs.columns and sorted(r["_bad"] for r in left.collect()) == list("bbd")
    d = "/root/testdata/sf0.001"
    for (_, stage), n in zip(pipeline.STAGES, (1, 5, 4, 5, 5), strict=True):
        out = stage(spark, docs, d)
        assert out.count() == n and (out.columns == docs.columns or "ids" in out.columns)
        assert stage(spark, docs.limit(0), d).count() == 0
