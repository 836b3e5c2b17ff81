"""Filter orders, repaired conversations and spliced token counts against plain Python."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vigilflow.llm import catalog, interactions, tokencounts, turns

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- orders of filters


def fails(text, doc_id, firsts):
    text = text or ""
    words = WORD.findall(text)
    first = firsts.get(text)
    return {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and first is not None and first < doc_id,
    }


def walked(docs, labels):
    """Every order applied to every document, one by one."""
    firsts = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            firsts[text or ""] = min(firsts.get(text or "", doc_id), doc_id)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    out = {}
    parts = {lang or "" for _, _, lang in docs}
    judged = [(lang or "", fails(text, i, firsts), i in good and i is not None, i in toxic and i is not None) for i, text, lang in docs]
    for part in parts:
        mine = [r for r in judged if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(r[1][f] for r in mine) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in mine),
                    sum(r[2] for r in gone), sum(r[3] for r in gone))
    shapley = collections.Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels):
    rows = interactions.audit(interactions.failure_counts(docs, labels, interactions.quality_failures), "ABCDE").collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


MANY = " ".join(f"w{i}" for i in range(120))
FILTERED = [
    (1, None, None), (2, "", "en"), (2, "", "en"), (3, "A B C $", ""), (4, MANY, "en"), (5, MANY, "fr"), (5, MANY, "en"), (9, MANY, None),
    (None, MANY, "en"), (None, None, None), (6, "the " * 150, "en"), (7, MANY + " %", "fr"), (7, MANY + " |", "fr"), (8, MANY.upper(), "de"),
]
MARKS = [(4, 1, 0), (4, 0, 0), (5, None, 1), (5, 1, None), (None, 1, 1), (6, 0, 1), (99, 1, 1), (9, 1, 0), (9, 1, 0)]


def test_orders_on_awkward_rows(spark):
    docs = spark.createDataFrame(FILTERED, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame(MARKS, "doc_id bigint, quality int, toxic int")
    expected = walked(FILTERED, MARKS)
    assert audited(docs, labels) == expected and len(expected) == 4 * 600
    wide = docs.select("*", *(F.lit("x").alias(c) for c in ("mask", "part", "id", "n", "good", "body", "edge", "state")))
    assert audited(wide, labels.withColumn("text", F.lit(1))) == expected
    assert audited(docs.limit(0), labels) == {}
    assert audited(docs, labels.limit(0)) == walked(FILTERED, [])


def test_op11(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    rows = catalog.queries()["op11_filter_lattice"](spark, sf_dir).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows} == walked(docs, labels)


def test_path_counts_are_those_of_all_orders():
    for k in range(1, 6):
        through = collections.Counter()
        for order in itertools.permutations(range(k)):
            for at, f in enumerate(order):
                through[sum(1 << x for x in order[:at]), f] += 1
        assert {(e.state, e.filter): e.reaching * e.leaving for e in interactions.lattice(k)} == through


def test_number_of_filters_is_checked(spark):
    with pytest.raises(ValueError):
        interactions.audit(spark.createDataFrame([], "part string, mask int, n bigint, good bigint, toxic bigint"), "ABCDEFG")


# ---------------------------------------------------------------- conversations


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        out.extend([(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def repaired(rows):
    """The audit of one conversation by uniform-cost search over (cost, edits)."""
    rows = after_damage(rows)
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    faults, seen = [], set()
    for _, role, text in rows:
        full = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    heap, closed = [(0, "", 0, "")], set()
    while True:
        cost, path, i, last = heapq.heappop(heap)
        if (i, last) in closed:
            continue
        closed.add((i, last))
        if i == len(rows) and last in ("", "a"):
            break
        follows = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 3, path + "I", i, follows))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, path + "D", i + 1, last))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] == "truncated" else 0
                own = rows[i][1][:1]
                if own == follows or own == "s" and last == "":
                    heapq.heappush(heap, (cost + extra, path + "K", i + 1, own))
                heapq.heappush(heap, (cost + extra + 3, path + "R", i + 1, follows))
    lines, last, i = [], "", 0
    for edit in path:
        follows = "a" if last == "u" else "u"
        name = {"a": "assistant", "u": "user"}[follows]
        if edit == "I":
            lines.append(name + ":")
        elif edit in "KR":
            lines.append(f"{rows[i][1] if edit == 'K' else name}:{rows[i][2]}")
        if edit != "D":
            last = rows[i][1][:1] if edit == "K" else follows
        i += edit != "I"
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, path, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_conversation(rows):
    convs = collections.defaultdict(list)
    for r in rows:
        convs[r[0]].append(tuple(r))
    return {c: repaired(r) for c, r in convs.items()}


def got(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_op12(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got(catalog.queries()["op12_turn_repair"](spark, sf_dir)) == by_conversation(rows)


def made_conversations(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", "So it is!\n", "and then", None, "A. B", "é."]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "agent", "u"])
            text = rng.choice(texts) if rng.random() < 0.5 else f"Turn {rng.randint(0, 9 * most)}{rng.choice(['.', '', '?'])}"
            rows.append((rng.choice([c, c, c, None]) if c % 7 == 0 else c, rng.choice([t, t, t, t + 1, None, 3 * t]), role, text))
    return rows


CONVERSATION = "conv_id bigint, turn bigint, role string, text string"


def test_awkward_conversations(spark):
    rows = made_conversations(1, 400, 9)
    df = spark.createDataFrame(rows, CONVERSATION)
    expected = by_conversation(rows)
    assert got(turns.repair(df.repartition(7))) == expected
    wide = df.select("*", *(F.lit("x").alias(c) for c in ("part", "no", "fault", "edit", "cost", "was", "gone", "case", "_long")))
    assert got(turns.repair(wide)) == expected
    assert turns.repair(df.limit(0)).count() == 0


def test_long_conversations_in_parts(spark):
    """Conversations cut into parts give the same edits; one holds most rows, one is without id, one starts with deleted rows."""
    rows = made_conversations(2, 30, 8)
    rows += [(1000, t, r, x) for _, t, r, x in made_conversations(3, 1, 1500) * 2] + [(None, t, r, x) for _, t, r, x in made_conversations(4, 60, 8)]
    rows += [(2000, t, "user", "") for t in range(200)] + [(2000, 500 + t, ("system", "user", "assistant")[t % 3], f"Part {t}.") for t in range(200)]
    rows += [(3000, 7, "user", "Same.")] * 300 + [(3001, 0, "system", f"Only {t}.") for t in range(90)]
    df = spark.createDataFrame(rows, CONVERSATION)
    assert got(turns.repair(df, long_rows=40)) == by_conversation(rows)


def test_edits_are_the_repaired_rows(spark):
    rows = [(1, 1, "system", "Be brief."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Hi."), (1, 5, "assistant", "Bye.")]
    kept = [r for r in turns.edits(spark.createDataFrame(rows, CONVERSATION)).collect() if r.role]
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in kept))
    assert {r.edit for r in kept} <= set("IKR")


def test_search_deepens_and_remembers():
    """A conversation that ends right behind the system's row is dearer than the abstraction says."""
    rows = [turns.Row(turns.SYSTEM, turns.FINE)]
    assert turns.lower_bounds(rows, (0, turns.NEVER, turns.NEVER, 0), True)[0][0] < turns.search(rows)[0] == 4
    assert turns.search(rows)[1] == "D"
    assert turns.search([]) == (0, "", turns.START)


# ---------------------------------------------------------------- token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE_BPE)
    return lambda text: len(tok.encode(text or "", add_special_tokens=False))


def test_op13(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = catalog.queries()["op13_spliced_counts"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {
        i: (len((t or "").encode()), library(t), library(t) > 512) for i, t in texts.items()}
    assert len(rows) == len(texts)


def awkward_texts(seed, n):
    rng = random.Random(seed)
    bits = ["don't", "we'll", "'re", "'", "<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n\n", "\t \n", "　", "word", "Wort", "12345", "!!??", "日本語",
            "\U0001f600", "é", " ", "a" * 30, "...", "-", "\x1c", "‍", "\x85"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 260))) for _ in range(n)]
    texts += ["a" * 900, " " * 700, " " * 500 + "x" + " " * 501, "<|endoftext|>" * 60, "\n" * 333 + "end", "x" * 300 + " " + "y " * 200 + "1" * 420, "'s" * 400]
    return texts


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 20), (200, 30), (96, 1)])
def test_splices_of_awkward_texts(spark, library, chunk, overlap):
    """Chunks far shorter than in production: every text is cut often, many cuts must be widened or given up."""
    texts = awkward_texts(chunk, 150)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = tokencounts.count(df, BYTE_BPE, chunk=chunk, overlap=overlap).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: library(t) for i, t in enumerate(texts)}


def test_huge_text_is_spread(spark, library):
    """A text of a million characters becomes some thirty chunks, copies of it are encoded once, their other columns stay."""
    text = " ".join(f"word{i % 977} it's" for i in range(90_000))
    df = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (2, None, "c"), (3, "", "d"), (None, "one two", "e")], "doc_id bigint, text string, key string")
    wide = df.select("*", *(F.lit(f"own {c}").alias(c) for c in ("rest", "body", "piece", "left", "cut", "n_bytes", "widths")))
    rows = tokencounts.count(wide, BYTE_BPE).collect()
    n = library(text)
    assert sorted((r.doc_id or 0, r.key, r.n_bytes, r.n_tokens) for r in rows) == [
        (0, "e", 7, 2), (1, "a", len(text), n), (1, "b", len(text), n), (2, "c", 0, 0), (3, "d", 0, 0)]
    assert {(r.rest, r.body, r.left, r.widths) for r in rows} == {("own rest", "own body", "own left", "own widths")}
    assert tokencounts.count(df.limit(0), BYTE_BPE).count() == 0
    assert len(tokencounts.pieces(len(text), tokencounts.CHUNK, tokencounts.OVERLAP, {})) > 25


def test_remembered_pre_tokens_are_the_librarys(library):
    """Every common character in every context that decides a pre-token, and uncommon ones beside them."""
    counter = tokencounts.Counter(BYTE_BPE, True)
    texts = [f"{a}{chr(c)}{b}" for c in range(0x260) for a, b in (("", ""), (" ", "x"), ("x", " 1"), ("'", "\n\n y"), ("1", "'ll"), ("  ", "  "))]
    texts += awkward_texts(5, 300) + ["x" * 50_000, "", "<|endoftext|>"]
    assert counter(texts) == [library(t) for t in texts]
    assert counter(texts[::-1]) == [library(t) for t in texts[::-1]] and len(counter.known) > 500


def test_only_tokenizers_that_allow_a_proof_are_cut(spark):
    assert tokencounts.margin_of(BYTE_BPE) == tokencounts.LOOK_AHEAD + len("<|endoftext|>")
    assert tokencounts.margin_of(public_tokenizers.path("word_bpe_49k.json")) is None
    df = spark.createDataFrame([(1, "Some words " * 20)], "doc_id bigint, text string")
    assert tokencounts.count(df, public_tokenizers.path("word_bpe_49k.json"), chunk=32, overlap=8).first().n_tokens == 40
    with pytest.raises(ValueError):
        tokencounts.count(df, BYTE_BPE, chunk=32, overlap=16)
