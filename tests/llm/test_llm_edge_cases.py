"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigilflow.llm import encode, language, lattice, mixing, pages, personal, secrets, shingles, substrings, trees
from vigilflow.llm.common import WordHasher, runs_of

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
CLASHES = ("_text", "_row", "_hash", "_id", "body", "rest", "base", "spans", "ids", "rep", "copies", "n", "key", "kept", "part", "no", "size", "rows", "taken", "marks", "hood", "_base", "_copy", "lang_pred", "n_words")
LONG = " ".join(f"word{i % 5000}" for i in range(200_000))
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "a", 3),
    (4, "the cat sat on the mat and the dog lay by the door of the old house", "en", "a", 60),
    (4, "the cat sat on the mat and the dog lay by the door of the old house", "en", "a", 60),
    (5, "the cat sat on the mat and the dog lay by the door of the old house", None, None, 60),
    (6, "mail me: someone@example.org or 10.0.0.1, password = hunter2222", "en", "b", 60),
    (7, "1234 5678 !!! ???", "de", "b", 17),
    (None, "der hund und die katze liegen auf der matte vor dem alten haus am see", "de", "b", 70),
    (8, LONG, "en", "c", len(LONG)),
    (9, "a\x00b ퟿ é é \U0001f600 <|endoftext|>", "fr", "c", 10),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def kept_as_they_were(out, but=()):
    names = [c for c in CLASHES if c not in but]
    assert out.select(*names).distinct().collect() == [tuple(f"own {c}" for c in names)]


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_encode(docs, wide, empty, vocabulary):
    rows = {r.doc_id: r for r in encode.encode(docs, vocabulary).collect()}
    assert rows[1].n_tokens == rows[2].n_tokens == rows[3].n_tokens == 0 and rows[1].decoded == ""
    assert rows[8].n_tokens > 200_000 and rows[9].decoded.endswith("<|endoftext|>")
    kept_as_they_were(encode.encode(wide, vocabulary), ("ids",))
    assert encode.encode(empty, vocabulary).count() == 0


def test_language(docs, wide, empty):
    model = language.train(docs)
    rows = language.predict(docs, model).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and by_id[1].score == 0
    assert by_id[8].lang_pred in model.languages and 0 < by_id[8].score <= 1
    kept_as_they_were(language.predict(wide, model), ("lang_pred",))
    nothing = language.train(empty)
    assert nothing.languages == [] and language.predict(empty, nothing).count() == 0
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def test_personal(docs, wide, empty):
    rows = {r.doc_id: r for r in personal.extract(docs).collect()}
    assert [(s.kind, s.value) for s in rows[6].base] == [("email", "someone@example.org"), ("ip", "10.0.0.1")]
    assert rows[1].base == [] and rows[8].base == []
    clean = {r.doc_id: r.text for r in personal.redact(docs).collect()}
    assert clean[6] == "mail me: [EMAIL] or [IP], password = hunter2222" and clean[1] is None and clean[8] == LONG
    kept_as_they_were(personal.extract(wide), ("base", "spans"))
    kept_as_they_were(personal.redact(wide))
    assert personal.extract(empty).count() == 0 and personal.redact(empty).columns == empty.columns


def test_secrets(docs, wide, empty):
    rows = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert [(s.kind, s.owners, s.live) for s in rows[6].spans] == [("assign", 1, True)]
    assert rows[1].base == [] and rows[1].spans == []
    assert secrets.scan(wide).count() == len(ROWS) and secrets.scan(empty).count() == 0


def test_substrings(docs, wide, empty):
    rows = {r.doc_id: r for r in substrings.remove(docs).collect()}
    assert (rows[4].n_words, rows[4].n_removed) == (17, 0)  # repeated rows are one document
    assert (rows[5].n_words, rows[5].n_removed, rows[5].kept) == (17, 17, "")
    assert rows[1].n_words == 0 and rows[8].n_removed == 0 and rows[8].n_words == 200_000
    assert substrings.remove(docs).count() == len(ROWS)
    kept_as_they_were(substrings.remove(wide), ("kept", "n_words"))
    assert substrings.remove(empty).count() == 0


def test_shingles(docs, wide, empty):
    rows = [tuple(r) for r in shingles.join(docs).orderBy("doc_id").collect()]
    assert [r for r in rows if r[0] in (4, 5)] == [(4, 2, 4), (4, 2, 4), (5, 2, 4)]
    assert (1, 0, 1) in rows and (2, 0, 2) in rows and len(rows) == len(ROWS) - 1  # the row without id is left out
    left = shingles.deduplicate(wide)
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == [1, 2, 3, 4, 6, 7, 8, 9]
    assert left.filter("doc_id is null").count() == 1
    kept_as_they_were(left)
    assert shingles.join(empty).count() == 0 and shingles.deduplicate(empty).count() == 0


A, B = "a text of some words that no other one is like", "the second of two texts, which differ in every word but few"


@pytest.mark.parametrize("order", [(0, 1, 2, 3, 4, 5), (1, 0, 2, 5, 4, 3), (5, 4, 3, 2, 1, 0)])
def test_texts_of_one_id_are_told_apart(spark, order):
    """No text goes with another one of its id, and the order of rows does not matter."""
    rows = [(1, A, "x"), (1, B, "x"), (2, B, "x"), (3, A, "x"), (3, "one that stands alone with its id", "x"), (1, A, "y")]
    left = shingles.deduplicate(spark.createDataFrame([rows[i] for i in order], "doc_id bigint, text string, source string").repartition(3))
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, A), (1, B), (3, "one that stands alone with its id")]
    again = shingles.deduplicate(spark.createDataFrame([rows[i] for i in order[::-1]], "doc_id bigint, text string, source string"))
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, again.collect()))


def test_mixing_of_repeated_rows(spark):
    """A source that is one row many times comes near its target too, with and without a source name."""
    words = " ".join(f"w{i}" for i in range(10))
    rows = [(1, words, "a", i % 7) for i in range(1000)] + [(i, words, "b", i) for i in range(1000)] + [(2, words, None, i % 3) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars int")
    planned = mixing.plan(docs).collect()
    assert sum(r.rows for r in planned) == 3000
    for name in ("a", "b", None):
        mine = [r for r in planned if r.source == name]
        assert abs(sum(r.rows * r.taken for r in mine) - mine[0].target) <= 10 and {r.copies for r in mine} <= {0, 1, 2}
    mixed = mixing.mix(docs)
    count = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert count == {name: sum(r.rows * r.copies for r in planned if r.source == name) for name in ("a", "b", None)}
    shape = lambda df: sorted(map(str, df.groupBy(*docs.columns).count().collect()))
    assert shape(mixed) == shape(mixing.mix(docs.repartition(5)))


def test_mixing(docs, wide, empty):
    rows = mixing.plan(docs).collect()
    assert sum(r.rows for r in rows) == len(ROWS)
    assert all(r.copies <= 2 and r.taken <= 2 * r.size for r in rows)
    assert sum(r.rows for r in rows if r.id == 4) == 2
    mixed = mixing.mix(wide)
    kept_as_they_were(mixed)
    assert mixed.count() == sum(r.rows * r.copies for r in rows)
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


PAGE = ("<html><body><nav><a href=/>Home</a></nav><article><h1>Title &amp; more</h1><p>First&nbsp;paragraph,\n of some length.<p>Second one, also"
        " of some length.</article><footer>&copy; us</footer>")


def test_pages(spark):
    schema = "page_id bigint, url string, html string, body string, rest string, text string"
    rows = [(1, "u", None, "b", "r", "t"), (2, "u", "", "b", "r", "t"), (3, "u", PAGE, "b", "r", "t"), (3, "u", PAGE, "b", "r", "t"),
            (4, "u", "<p", "b", "r", "t"), (5, "u", "<script>var a='<p>x</p>'", "b", "r", "t"),
            (6, "u", "<body><article>" + "<p>a longer paragraph, made of words.</p>" * 3000, "b", "r", "t")]
    table = spark.createDataFrame(rows, schema)
    labeller = pages.train(table, p=pages.LabellerParams(layouts=150, epochs=6))
    out = pages.extract(table, labeller)
    by_id = {r.page_id: r for r in out.collect()}
    assert out.count() == len(rows) and by_id[3].text == "Title & more\nFirst paragraph, of some length.\nSecond one, also of some length."
    assert [by_id[i].text for i in (1, 2, 4, 5)] == [""] * 4 and by_id[3].body == "b" and by_id[3].rest == "r"
    assert by_id[6].n_chars == len(by_id[6].text) > 50_000
    assert pages.extract(table.limit(0), labeller).count() == 0
    pages.train(table.limit(0), p=pages.LabellerParams(layouts=20, epochs=1))


def test_blocks_of_custom_and_unclosed_elements():
    def texts(page):
        return [b.text for b in pages.blocks_of(page)]

    for name in ("svg-icon", "object-card", "template-x", "math-field", "script-note", "iframe-box"):
        assert texts(f"<p>a</p><{name} name=x></{name}><p>b</p>") == ["a", "b"]
    for name in ("svg", "math", "object", "noscript", "canvas", "template", "textarea", "iframe"):
        assert texts(f"<p>a</p><{name} id=x><p>b</p><p>c</p>") == ["a", "b", "c"]
    assert texts("<p>a</p><script>var x = 1;<p>b</p>") == ["a", "b"]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><object data=f>no film</object>") == ["so x=2 holds", "no film"]
    assert texts("<p>a</p><STYLE>p {}</style ><script src=x>if (a<b) {}</script><template><p>no</p></template><textarea>no</textarea>b<iframe>no</iframe>") == ["a", "b"]
    assert len(texts("<script>" * 20_000 + "<p>b</p>")) == 1
    page = "<article>" + "<div>" * 500 + "x" + "</div>" * 200 + "y" + "</div>" * 300 + "z</article>"
    assert [(b.text, len(b.path)) for b in pages.blocks_of(page)] == [("x", 400), ("y", 301), ("z", 1)]


def test_patterns_discover_among_few_seeds_and_many_unknown_values(spark):
    cards = ["4111111111111111", "4012888888881881", "4222222222222", "5555555555554444", "5105105105105100", "378282246310005"]
    rows = [(i, f"please charge card number {c} today") for i, c in enumerate(cards)]
    rows += [(20, "the card number 4111-1111-1111-0112 was refused"), (21, "the card number 4111 1111 1111 1112 was refused")]
    rows += [(30 + i, f"so phone me +49 30 12345{i}7 today") for i in range(6)]
    rows += [(40 + i, f"so phone me 017-555-77{i:02d} today") for i in range(20)] + [(60, "so phone me (017) 555-7713 today")]
    rows += [(100 + i, f"they sold of the {n} items and of the 10.1.{i}.1 rest") for i, n in enumerate(range(10000, 10020))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in personal.extract(table).collect()}
    assert [(s.kind, s.value) for i in (20, 21) for s in found[i].spans] == [("card", "4111-1111-1111-0112"), ("card", "4111 1111 1111 1112")]
    assert all([(s.kind, s.value) for s in found[40 + i].spans] == [("phone", f"017-555-77{i:02d}")] for i in range(20))
    assert [(s.kind, s.value) for s in found[60].spans] == [("phone", "(017) 555-7713")]
    assert all(r.spans == r.base for i, r in found.items() if i < 20 or i >= 100)
    assert {r.doc_id: r.text for r in personal.redact(table).collect()}[60] == "so phone me [PHONE] today"


def test_patterns_discover_with_six_seeds(spark):
    cards = ["4111111111111111", "4012888888881881", "4222222222222", "5555555555554444", "5105105105105100", "378282246310005"]
    rows = [(i, f"please charge card number {c} today") for i, c in enumerate(cards)] + [(90, "the card number 4111-1111-1111-0112 was refused")]
    found = {r.doc_id: r for r in personal.extract(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [(s.kind, s.value) for s in found[90].spans] == [("card", "4111-1111-1111-0112")] and found[90].base == []


NAN, INF = float("nan"), float("inf")
VECTORS = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 0.0, 0.0]),
           (5, None), (6, []), (7, [NAN, 1.0, 0.0]), (8, [INF, 1.0, 0.0]), (9, [None, 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (11, [1e-30, 0.0, 0.0])]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors(spark, kind):
    rows = spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<double>").withColumns(
        {"embedding": F.col("embedding").cast(f"array<{kind}>"), "v": F.lit(1), "rep": F.lit(2), "query": F.lit(3), "leaf": F.lit(4)})
    out = [tuple(r) for r in lattice.links(rows).orderBy("vec_id").collect()]
    assert [r[1:] for r in out if r[0] in (0, 1, 2, 11)] == [(3, 0)] * 4
    assert [r for r in out if r[0] == 3] == [(3, 1, 3), (3, 1, 3)]
    assert all(n == 0 and c == i for i, n, c in out if i in (4, 5, 6, 7, 8, 9, 10)) and len(out) == len(VECTORS) - 1
    found = [tuple(r) for r in trees.nearest(rows, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [(q, k, i) for q, k, i, _ in found] == [(0, 1, 1), (0, 2, 11), (0, 3, 2), (0, 4, 3)]
    assert lattice.links(rows.limit(0)).count() == 0 and trees.nearest(rows.limit(0), F.lit(True)).count() == 0
    assert trees.nearest(rows, F.lit(False)).count() == 0


def test_neighbours_among_equal_vectors_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    near, far = np.array([1.0, 0.1, 0.0, 0.0]), rng.standard_normal((40, 4)) * 0.01 + np.array([1.0, -0.5, 0.0, 0.0])
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(i, near.tolist()) for i in rng.permutation(np.arange(1, 1001)).tolist()]
    found = trees.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id").isin(0, 3)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(0, i) for i in (1, 2, 3, 4, 5)] + [(3, i) for i in (1, 2, 4, 5, 6)]
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(7, (near + rng.standard_normal(4) * 1e-3).tolist()) for _ in range(50)] + [(100 + i, v.tolist()) for i, v in enumerate(far)]
    score = {i: max(v[0] / np.linalg.norm(v) for j, v in rows if j == i) for i in {j for j, _ in rows[1:]}}
    found = trees.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in found] == sorted(score, key=lambda i: (-score[i], i))[:5] and found[0].vec_id == 7


def test_stock_phrase_among_thousands_of_neighbours(spark, monkeypatch):
    hasher, rng = WordHasher(), np.random.default_rng(5)
    phrases = [" ".join(f"p{x}" for x in rng.integers(0, 1000, 5)) for _ in range(20_000)]
    phrase = min(phrases, key=lambda p: runs_of(*hasher(pa.array([p])), 5)[0][0])  # the least hash of its windows
    sides = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 12)) for _ in range(12_000)]
    texts = [f"{sides[2 * i - 8 if i % 10 == 9 else 2 * i]} {phrase} {sides[2 * i + 1]}" for i in range(6000)]
    texts += [texts[0], f"{phrase} {sides[1]} end"]
    first, expected = {}, []
    for text in texts:
        words = text.split()
        gone = set()
        for k in range(len(words) - 12):
            if tuple(words[k : k + 13]) in first:
                gone.update(range(k, k + 13))
        for k in range(len(words) - 12):
            first.setdefault(tuple(words[k : k + 13]), True)
        expected.append(" ".join(w for k, w in enumerate(words) if k not in gone))
    add = substrings.SuffixAutomaton.add

    def bounded(self, symbols, doc):
        assert len(self.size) < 100_000, "one automaton holds all the neighbours of a phrase"
        add(self, symbols, doc)

    monkeypatch.setattr(substrings.SuffixAutomaton, "add", bounded)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r.kept for r in substrings.remove(rows).orderBy("doc_id").collect()] == expected
    assert sum(a != b for a, b in zip(expected, texts, strict=True)) == 602


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, wide, empty, stage):
    last = stage is corpus_pipeline.STAGES[-1][1]
    out = stage(spark, wide, "")
    assert out.count() > 0 and (last or out.columns == wide.columns)
    assert stage(spark, empty, "").count() == 0
    # a second run gives the same rows
    assert sorted(map(str, stage(spark, docs, "").select("doc_id").collect())) == sorted(map(str, stage(spark, docs, "").select("doc_id").collect()))


def test_long_and_deep_pages_are_read_whole(monkeypatch):
    """Labels do not depend on how many steps are multiplied at once; blocks below the deepest named element keep their text."""
    from vigilflow.llm import pages

    labeller = pages.Labeller(6, 1)
    page = "<body>" + "".join(f"<p class=c{i % 7}>word{i % 11} text {i}</p>" for i in range(300)) + "</body>"
    features = pages.Features()([pages.blocks_of(page), pages.blocks_of("<p>short</p>")])
    both, alone = labeller.scores(*pages.padded(features))[0], labeller.scores(*pages.padded(features[:1]))[0]
    monkeypatch.setattr(pages, "STRETCH", 7)
    assert np.allclose(labeller.scores(*pages.padded(features))[0], both, atol=1e-5) and np.allclose(alone[0], both[0], atol=1e-5)
    tapes = ([], [])
    labeller.scores(*pages.padded(features[:1]), tapes)
    assert [t[0] for t in tapes[0]] == list(range(300)) and [t[0] for t in tapes[1]] == list(range(299, -1, -1))
    monkeypatch.undo()
    many = pages.blocks_of("<p>x</p>" * 30_000)
    chosen = labeller.main_blocks(pages.Features()([many]))
    assert len(chosen[0]) == 30_000
    deep = pages.blocks_of("".join(f"<div id=d{i}>t{i} " for i in range(600)) + "</div>" * 600 + "<p>after</p>")
    assert [b.text for b in deep] == [*(f"t{i}" for i in range(600)), "after"]
    assert len(deep[599].path) == pages.OPEN and deep[600].path == ("p",)
    assert [len(b.path) for b in pages.blocks_of("<div>a<div>b<div>c", most_open=2)] == [1, 2, 2]
