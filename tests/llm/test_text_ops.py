"""Encoders, extraction, rules: against libraries, other code or an exact round trip."""

import hashlib
import html as entities
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tidemark.llm.queries")

from tidemark.llm import bpe, decontaminate, html, quality, queries, rans, secrets, urls  # noqa: E402

PIECES = ["a", "b", " ", "  ", "\n", "\t", "é", "漢", "🙂", "'s", "'S", "1", "22", "!!", "\x1c", "\x85", "　", "\xa0", "the", "tion", "\r\n", "ß", "İ", "_", "'ll", "aaaaaaaa", "Ⅷ"]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return [None, "", " ", "\n\n", "x" * 30_000, "ab " * 9_000] + ["".join(r.choice(PIECES) for _ in range(r.randint(0, 30))) for _ in range(n)]


def docs_of(spark, texts, extra=True):
    rows = [(i, t, "src%d" % (i % 3), "en", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_tokens string")


def real(spark, name="documents"):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path = queries.tokenizer("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    ref = tiktoken.Encoding("own", pat_str=queries.pattern(), mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts(3000) + [r["text"] for r in real(spark).collect()]
    enc = bpe.Encoder(ranks, queries.pattern(), memo=500)
    for t in texts:
        got = enc.encode(t or "")
        assert got == ref.encode_ordinary(t or "") and enc.decode(got) == (t or "").encode()
    rows = {r["doc_id"]: r for r in bpe.round_trip(docs_of(spark, texts[:40]), path, queries.pattern(), with_ids=True).collect()}
    for i, t in enumerate(texts[:40]):
        ids = ref.encode_ordinary(t or "")
        assert rows[i]["ids"] == ids and rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs_of(spark, texts[:9]), path, queries.pattern()), path, queries.pattern())
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(texts[:9])}
    assert bpe.encode(docs_of(spark, texts[:1]).limit(0), path, queries.pattern()).count() == 0


def test_rans_blocks():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 1000, 200_000):
        ids = np.minimum(r.zipf(1.3, n), 50_000).astype(np.uint32) if n else np.zeros(0, np.uint32)
        symbols, counts = np.unique(ids, return_counts=True)
        table = rans.Table.of_counts(symbols.astype(np.int64), counts)
        payload = rans.encode_block(ids, table)
        assert (rans.decode_block(payload, table) == ids).all()
    lanes = rans.HEADER.unpack_from(payload)[2]
    assert (rans.decode_block(payload, table, 1) == ids[rans.EVERY * lanes :]).all()
    assert len(payload) < 2 * n


def test_rans_files_equal_tokenizers(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["<|endoftext|>x", "a  <|endoftext|>", "x <|endoftext|> y\n <|endoftext|>\n b", "<|endoftext|", " a\n b \nc  d", "\n\n x"] + odd_texts(60) + [r["text"] for r in real(spark).limit(40).collect()]
    rows = sorted(rans.written_and_read(docs_of(spark, texts), path, with_ids=True).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, x in zip(rows, texts, strict=True):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert rans.written_and_read(docs_of(spark, texts).limit(0), path).count() == 0


def test_html(spark):
    rows = real(spark, "pages").collect()
    for r in rows:
        want = []
        for block in re.split(r"</?(?:p|h1)[^>]*>", re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)):
            text = " ".join(entities.unescape(re.sub(r"<[^>]*>", "", block.replace("<br>", " "))).split())
            want += [text] if text else []
        assert html.extract(r["html"]) == "\n\n".join(want)
    long = "word " * 40
    page = f'<body><div class="top-menu"><a href=x>home</a></div><div><h1>T &amp; U</h1></div><div class=post><p>{long}<p>short</div><div id="comments"><p>{long}</p></div><aside>{long}</aside><form>{long}</form><script>"</p>"</script></body>'
    assert html.extract(page) == f"T & U\n\n{long.strip()}\n\nshort"
    assert html.extract(None) == html.extract("") == html.extract("<nav>x</nav>") == ""
    assert html.extract("<p>a\n b&nbsp;c</p><p>d</p>") == "a b c\n\nd"
    df = spark.createDataFrame([(1, None, None), (1, "u", page)], "page_id long, url string, html string")
    assert sorted(r["n_chars"] for r in html.main_text(df).collect()) == [0, len(html.extract(page))]


def test_html_searches_all_lines_of_a_page():
    long, card = "word " * 40, "teaser " * 7
    cards = "".join(f"<article class=card><h3>Card {i}</h3><p>{card}</p></article>" for i in range(3))
    for page in (f"<body><div id=content><h1>T</h1><p>{long}</p><p>{long}</p></div>{cards}</body>", f"<body>{cards}<div id=content><h1>T</h1><p>{long}</p><p>{long}</p></div></body>"):
        got = html.extract(page).split("\n\n")
        assert got.count(long.strip()) == 2 and "T" in got
    bounded = f"<body><div>Site</div><article><h1>T</h1><ul><li>a</ul><p>b</p><ul><li>c</ul><p>{long}</p><p>end</article><div>Imprint</div></body>"
    assert html.extract(bounded) == f"T\n\na\n\nb\n\nc\n\n{long.strip()}\n\nend"


def test_html_keeps_short_containers_of_the_text():
    long = ("word " * 40).strip()
    links = "<div><ul><li><a href=x>a linked headline</a></li><li><a href=y>another linked one</a></li></ul></div>"
    lead = f"{links}<div class=post><p>{long}</p><h2>Steps</h2>"
    ends = {
        "<ul><li>Mix</li><li>Bake</li></ul>": ["Mix", "Bake"],
        "<blockquote>Quoth</blockquote>": ["Quoth"],
        "<table><tr><td>1</td><td>2</td></tr></table>": ["1", "2"],
        "<dl><dt>A</dt><dd>b</dd></dl>": ["A", "b"],
        "<div><p>The end.</p></div>": ["The end."],
        f"<ul><li>x</li></ul><ol><li><a href=z>see</a></li></ol><p>{long}</p><div>z</div>": ["x", "see", long, "z"],
    }
    for end, want in ends.items():
        assert html.extract(f"<body>{lead}{end}</div>{links}</body>").split("\n\n") == [long, "Steps", *want]


def test_html_ends_dropped_elements_without_end_tags():
    cases = {
        "<p class=notice>Hi<p>Body</p><p>More</p>": ["Body", "More"],
        "<div><p class=legal>Hi</div><p>Body</p>": ["Body"],
        "<p class=notice>Hi<b>!<div>Body</div><p>More": ["Body", "More"],
        "<ul><li class=social>Hi<li>Body</li><li>More</ul><p>End</p>": ["Body", "More", "End"],
        "<ul><li class=social>Hi<ul><li>in<li>in</ul>Hi<li>Body</ul>": ["Body"],
        "<ul><li class=social>Hi</ul><ul><li>Body</li></ul>": ["Body"],
        "<dl><dt class=related>Hi<dd class=related>Hi<dt>Body<dd>More</dl>": ["Body", "More"],
        "<table><tr class=search><td>Hi<td>Hi<tr><td class=ad>Hi<td>Body</td></tr></table><p>End</p>": ["Body", "End"],
        "<table><tr><td><p class=ad>Hi<td>Body<tr><td class=ad>Hi</table><p>End</p>": ["Body", "End"],
        "<div><div class=ad>Hi<p>Hi<div>Hi</div>Hi</div><p>Body</div>": ["Body"],
        "<aside>Hi<p>Hi<ul><li>Hi</ul></div>Hi</aside><p>Body": ["Body"],
        "<p>Body <span class=ad>Hi<div>Hi</div></span> more</p>": ["Body", "more"],
    }
    for page, want in cases.items():
        assert " ".join(html.extract(f"<body>{page}</body>").split()) == " ".join(want), page
    assert html.extract("<div><p class=ad>x<table><tr><td>" + "<div></p></li></q>" * 50_000 + "</table>Body") == "Body"


def test_url_rules_and_templates(spark):
    cases = [(None, "", ""), ("x/y", "", ""), ("http://A.Example.COM/en/1?q#f", "a.example.com", "/en/1"), ("s://h?x", "h", ""), ("a://b://c/d", "b:", "//c/d"), ("http://example.com/en/7x", "example.com", "/en/7x"), ("http://notcom/en/", "notcom", "/en/")]
    many = [(f"http://spam.org/{'es' if i % 2 else 'fr'}/{i}/", None, None) for i in range(40)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases + many)], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(df, queries.RULES).collect()}
    for i, (_, host, path) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"]) == (host, path)
    assert [got[i]["rule"] for i in (2, 5, 6)] == ["com/en/", "example.com/en/7", None]
    assert got[5]["verdict"] == "allow" and got[2]["verdict"] == "block" and got[0]["verdict"] == "allow"
    for i, (u, _, _) in enumerate(many, len(cases)):
        assert got[i]["verdict"] == ("block" if "/es/" in u else "allow")
    # unruled pages of a template that is mostly blocked
    more = [("block", "h.net/a/1")]
    df = spark.createDataFrame([(i, f"http://h.net/a/{'1' if i < 30 else '2'}{i}") for i in range(40)], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge(df, more).collect()} == {"block"}
    assert urls.judge(df.limit(0), more).count() == 0


def test_url_templates_reach_the_deepest_segment(spark):
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:03}")
    rules = [("block", "site.com/a/b/c/spam/")]
    paths = ["/a/b/c/spam/x"] + [f"/a/b/c/docs/{word(i)}" for i in range(20)] + [f"/d/e/f/g/{word(i)}/end" for i in range(20)] + ["/d" * 3000]
    df = spark.createDataFrame([(i, f"http://site.com{p}") for i, p in enumerate(paths)], "page_id long, url string")
    got = {r["path"]: r for r in urls.judge(df, rules).collect()}
    assert len(got) == len(paths) and {p for p, r in got.items() if r["verdict"] == "block"} == {"/a/b/c/spam/x"}
    assert {got[p]["template"] for p in paths[1:21]} == {"/a/b/c/docs/*"} and {got[p]["template"] for p in paths[21:41]} == {"/d/e/f/g/*/end"}
    assert got[paths[0]]["template"] in ("/a/b/c/spam/x", "/*/b/c/spam/x") and got[paths[-1]]["template"] == "/d" * 3000


def test_secrets(spark):
    kinds = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2), ("access", "AKIA[A-Z0-9]+", 18, 0), ("hex", "[0-9a-f]+", 16, 0)]
    texts = [None, "", "é\x01 token=secret:abcdefghijklmnop", "PassWord = 'abcdefABCDEF1' AKIA" + "Z9" * 8 + " deadbeefdeadbeef0", "漢token=abc secret=0123456789abcdef0", "AKIAAKIA" + "A" * 13, "Kk9_" * 9 + " x", "Kk9_" * 9]
    rows = [(i, t, f"s{i}", "en") for i, t in enumerate(texts)] + [(100 + r["doc_id"], r["text"], r["source"], r["lang"]) for r in real(spark).collect()]
    got = {r["doc_id"]: r for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    for i, t, *_ in rows:
        spans = sorted((m.start(), k, n, m.end()) for k, (n, p, least, g) in enumerate(kinds) for m in re.finditer(p, t or "") if len(m.group(g)) >= least)
        text = ",".join(f"{n}:{a}:{b}" for a, _, n, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (i, spans, got[i])
        assert [got[i][f"n_{k[0]}"] for k in kinds] == [sum(s[2] == k[0] for s in spans) for k in kinds]
        assert set(filter(None, text.split(","))) <= set(got[i]["spans"].split(","))
    assert got[6]["n_shared"] == 1 and got[6]["n_live"] == 0 and "mixed" not in got[6]["spans"]
    one = spark.createDataFrame([(1, "Kk9_" * 9, "a", None)], "doc_id long, text string, source string, lang string")
    assert secrets.find(one).first()["spans"] == "mixed:0:36"


def test_secrets_count_copies_of_a_document_once(spark):
    key, other = "Kk9_" * 9, "Zz8_" * 9
    rows = [(1, f"{key} x", "a", "en"), (2, f"{key} x", "b", "en"), (3, f"{other} x", "a", "en"), (4, f"{other} y", "b", "en")]
    got = {r["doc_id"]: r for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert [(got[i]["n_live"], got[i]["n_shared"], got[i]["spans"]) for i in (1, 2, 3, 4)] == [(1, 0, "mixed:0:36")] * 2 + [(0, 1, "")] * 2


def test_quality(spark):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    texts = [None, "", "a b c a b c a b c", "x\x0by\n\n \nx\x0by", "w " * 5000, "é# *| <&>$%"] + [r["text"] for r in real(spark).collect()]
    featured = quality.features(docs_of(spark, texts)).cache()
    for r in featured.collect():
        t = texts[r["doc_id"]] or ""
        w = word.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if word.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert tuple(r["_q"][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
    model = quality.learn(featured)
    kept = {r["doc_id"]: r for r in quality.judge(featured, model).collect()}
    assert not kept[0]["kept"] and kept[0]["base_failed"]
    assert quality.learn(featured.limit(0)).weights[0] == (0.0, 0.0, 0.0)
    v = (0,) * len(quality.RULES)
    small = quality.fit([(v, 900), ((-1, *v[1:]), 10), ((-1, -1, *v[2:]), 60)], len(v))
    assert small.weights[0][0] < 0 and all(len(w) == 3 and w[1] == 0 for w in small.weights)


def test_quality_against_labels(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op8_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id").where("not base_failed").collect()
    assert all(r["kept"] for r in got if r["label"] == 1 and not r["toxic"])
    bad = [r for r in got if r["label"] == 0]
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)


def _edit(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    items = [" ".join(word() for _ in range(30)) for _ in range(12)] + ["too short", None, ""]
    fill = lambda: " ".join(word() for _ in range(60))
    texts, want = [None, "", "short"], set()
    for i, item in enumerate(items[:12]):
        chars = list(item)
        for _ in range(i):  # i edits
            k = r.randrange(len(chars))
            chars[k : k + r.randint(0, 1)] = [r.choice("xyz")] * r.randint(0, 2)
        texts.append(f"{fill()}\n{''.join(chars).upper()}\t{fill()}")
        texts.append(fill())
        texts.append(fill() + " " + item[: len(item) // 2])
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            if item and len(item) >= decontaminate.MIN_CHARS and t:
                norm = lambda x: " ".join(x.lower().split())
                if _edit(norm(item), norm(t)) <= int(decontaminate.RATE * len(norm(item))):
                    want.add((d, k))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contaminated(docs_of(spark, texts), bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want and len(want) >= 12
    left = decontaminate.clean(docs_of(spark, texts), bench)
    assert {x["doc_id"] for x in left.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.contaminated(docs_of(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_of_short_items(spark):
    r = random.Random(6)
    items = ["What is  2+2?", "art", "Who won?", "漢字", "x" * 39, "who won?", "no such thing", "é", " "]
    texts = [None, "", "q: what\nis 2+2? a: 4", "party", "An ART.", "who won", "(who won?)", "彼は漢字を", "x" * 39, "x" * 40, "Étude é", "start"]
    texts += ["".join(r.choice(["a", "art", " ", "é", "漢字", ".", "who won?", "\n"]) for _ in range(r.randint(1, 9))) for _ in range(200)]
    norm = lambda x: " ".join((x or "").lower().split())
    word = lambda c: c.isalnum() and c < "\u2e80"
    want = set()
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            a, b = norm(t), norm(item)
            places = [i for i in range(len(a) - len(b) + 1) if b and a[i : i + len(b)] == b]
            free = [i for i in places if not (i and word(a[i - 1]) and word(a[i])) and not (i + len(b) < len(a) and word(a[i + len(b) - 1]) and word(a[i + len(b)]))]
            want |= {(d, k, 0, i, i + len(b)) for i in free[:1]}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {tuple(x) for x in decontaminate.contaminated(docs_of(spark, texts), bench).collect()} == want
    assert {(2, 0), (4, 1), (6, 2), (6, 5), (7, 3), (8, 4), (10, 7)} <= {x[:2] for x in want} and not {3, 5, 9, 11} & {x[0] for x in want}


def test_rans_encoder_equals_library():
    import random

    import public_tokenizers

    from tidemark.llm.rans import Encoder

    encoder, r = Encoder(public_tokenizers.path("byte_bpe_50k.json"), 1000), random.Random(1)
    letters = list("aZé'st.,'dll  \n\t09$_<|>-`ñ中̀’\x85 ǅª½")
    texts = ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(3000)]
    texts += [f"a{chr(c)}{m}b{chr(c)}" for c in range(1, 700) for m in ("", "é", ".")] + [None, "", "<|endoftext|>x", "don't.'s we'll'd", "a'" * 50]
    for t in texts:
        assert encoder.blob(t) == np.array(encoder.library.encode(t or "", add_special_tokens=False).ids, encoder.width).tobytes(), t


def test_html_of_odd_pages_in_linear_time():
    import time

    long = ("word " * 40).strip()
    cases = {
        f"<html><head><title>T</title><body><article><p>{long}</article>": long,
        f"<body><select><p>{long}": long,
        f"<body><button>x<p>{long}": f"x\n\n{long}",
        f"<body><select><option>x</select><p>{long}<script>if (a<b) '</p>'": long,
        f"<p>{long} &l<b></b>t; &lt;</p>": f"{long} &lt; <",
        f"<div class=post><p>{long}</p><div class='legal-history'>The law of 1900.</div><div class='ad-banner top'>Buy</div></div>": f"{long}\n\nThe law of 1900.",
        f"<p>{long}</p><div id=reader-comments><p>{long}</p></div><!-- x": long,
        f"<p>{long}</p><p>end <b": f"{long}\n\nend",
    }
    for page, want in cases.items():
        assert html.extract(page) == want, page
    begun = time.time()
    for page in ("<a" * 2_500_000, "<svg>" * 300_000, "<div class=ad>" * 100_000 + "</div>", '<a "' * 500_000 + ">", "<!--" * 500_000, "&" * 2_000_000, "<select>" * 200_000 + "</select>", "<p class=ad>" * 100_000):
        html.extract(page)
    assert time.time() - begun < 60


def test_html_without_article_elements(spark):
    """The given pages with their article elements' names taken away: line blocks alone find the same text."""
    for r in real(spark, "pages").collect():
        assert html.extract(re.sub("</?article>", "", r["html"])) == html.extract(r["html"]) != ""
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    odd = spark.createDataFrame([(None, "u", "<p>x</p>", 3, "t"), (1, None, "<p>x</p>", 4, "t")], "page_id long, url string, html string, n_chars long, text string")
    assert sorted((x["page_id"] or 0, x["text"], x["n_chars"]) for x in html.main_text(odd).collect()) == [(0, "x", 1), (1, "x", 1)]


def test_secrets_of_long_texts(spark):
    import time

    texts = [" ".join(f"{i:016x}" for i in range(100_000)), "token=abcdefghijkl " * 30_000, "x" * 3_000_000, None, "token=abcdefghij0123456789XYZ " * 30_000, "Kk9_Kk9_Kk9_Kk9_Kk9_ 0123456789abcdef0 /token=Kk9_Kk9_Kk9_Kk9_Kk9_ Zz1_Zz1_Zz1_Zz1_Zz1_"]
    docs = spark.createDataFrame([(i, t, None, None, "z") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, owner string")
    begun = time.time()
    got = {r["doc_id"]: r for r in secrets.find(docs).collect()}
    assert time.time() - begun < 100
    assert got[0]["base_sha256"] == hashlib.sha256(",".join(f"hex:{17 * i}:{17 * i + 16}" for i in range(100_000)).encode()).hexdigest()
    assert got[1]["base_sha256"] == hashlib.sha256(",".join(f"assign:{19 * i}:{19 * i + 18}" for i in range(30_000)).encode()).hexdigest()
    assert got[4]["spans"].count(",") == 29_999 and got[5]["spans"] == "mixed:0:20,hex:21:38,assign:40:66,mixed:67:87"
    assert got[1]["n_assign"] == 30_000 and got[2]["spans"] == got[3]["spans"] == "" and got[0]["n_hex"] == 100_000
    assert secrets.find(docs.limit(0)).count() == 0
