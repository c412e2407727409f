"""Edge cases and brute-force versions of the corpus operators."""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tests.oracle import same
from varspan.llm import common, exact_dedup, html_text, langid, mixing, packing, pii, quality_model, quality_rules, simhash, toxicity
from varspan.llm import queries as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, digest string, kept boolean, bucket int"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977} other" for i in range(30000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "the quick  brown\tfox jumps over the lazy dog", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, "   \n\t ", None, "b"),
    (None, "der schnelle braune fuchs springt", "de", None),
    (6, "1234 !!! 5678", "de", "a"),
    (7, LONG, "en", "a"),
    (7, LONG, "en", "a"),
    (8, "die katze sitzt auf der matte und der hund schläft", "de", "a"),
    (9, "x", None, "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "clash", "clash", True, 1) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (8, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracles(spark, sf, name):
    same(spark, sf, Q.QUERIES[name], Q.ORACLES[name])


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items, linked):
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


def test_simhash_against_brute_force(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    fps = [fingerprint(t) for t in docs.text]
    root = components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for r, i in zip(root, docs.doc_id):
        least[r] = min(least.get(r, 1 << 62), i)
    got = Q.op6_simhash(spark, sf).toPandas().set_index("doc_id")
    for i, f, r in zip(docs.doc_id, fps, root):
        assert got.fingerprint[i] == f"{f:016x}" and got.component_id[i] == least[r]


def test_simhash_links_in_large_buckets(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 62, 30)]
    fps = set(base)
    for b in base[:3]:  # dense clusters: many fingerprints around one
        for _ in range(90):
            i, j = rng.integers(0, 64, 2)
            fps.add(b ^ (1 << int(i)) ^ (1 << int(j)))
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    expected = components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    for masks, bucket in ((simhash.plan_masks(df), 48), (simhash.plan_masks(df), 2), (simhash.plan_masks(df, options=(2,)), 48)):
        edges = simhash.links(df, masks, bucket)
        rows = edges.collect()
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in rows)
        roots = {r.node: r.root for r in simhash.components(edges).collect()}
        group = {}
        for f, e in zip(fps, expected):
            s = f - (1 << 64) if f >> 63 else f
            group.setdefault(e, set()).add(roots.get(s, s))
        assert all(len(g) == 1 for g in group.values()) and len({min(g) for g in group.values()}) == len(group)


def test_threshold_allocation():
    total, chosen = simhash.allocate([{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 1, 1: 8}, {-1: 0, 0: 100, 1: 900}], 0)
    assert (total, chosen) == (13, [0, 1, -1])


def test_simhash_edge_cases(docs, empty):
    rows = simhash.op6_simhash(docs).toPandas()
    assert len(rows) == len(ROWS)
    blank = rows[rows.fingerprint == "0" * 16]
    assert set(blank.component_id) == {3} and set(blank.doc_id.dropna()) >= {3, 4, 5}
    assert simhash.op6_simhash(empty).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 3, None}


def test_exact_dedup_edge_cases(docs, empty):
    rows = exact_dedup.op10_exact_dedup(docs).toPandas()
    by = {int(r.doc_id): r for r in rows.itertuples() if r.doc_id == r.doc_id}
    assert by[2].keep_id == 1 and not by[2].kept and by[1].kept and by[1].group_size == 2
    assert by[4].keep_id == 3 and by[5].keep_id == 5  # white space alone is one space, not empty
    assert rows[rows.doc_id == 7].kept.tolist().count(True) == 1
    assert exact_dedup.op10_exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 5, None, 6, 7, 8, 9])


def test_exact_dedup_keeps_one_defined_row_of_each_text(spark):
    rows = [(5, "a  b", "z", 1), (5, "a b", "y", 2), (None, "a\tb", "x", 3), (7, "a b", "w", 4), (8, "only", "v", 5), (None, None, "u", 6), (None, "", "t", 7), (9, "", "s", 8)]
    schema = "doc_id long, text string, digest_of_text string, salt int"
    kept = [sorted(map(tuple, exact_dedup.drop_exact_duplicates(spark.createDataFrame(r, schema).repartition(n)).collect()), key=str) for r, n in ((rows, 1), (rows[::-1], 3))]
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [5, 8, 9]
    assert exact_dedup.drop_exact_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_digest_filter_loses_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), "id")
    some = rows.where("id % 10 = 0")
    for most in (1 << 28, 1 << 15):  # wide enough, and full
        monkeypatch.setattr(common, "MOST_BITS", most)
        got = {r.id for r in common.where_held(rows, "digest", common.value_filter(some, "digest")).collect()}
        assert got >= set(range(0, 3000, 10)) and len(got) < 1000
    marked = common.where_held(rows, "digest", common.value_filter(some, "digest"), "held").collect()
    assert len(marked) == 3000 and {r.id for r in marked if r.held} == got


def test_filter_does_not_shuffle_texts(spark):
    texts = spark.range(2000).selectExpr("repeat('x', 500) as body", "unhex(sha2(cast(id as string), 256)) as digest")
    found = common.value_filter(texts.limit(10), "digest")
    plan = common.where_held(texts, "digest", found)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan.split("BroadcastExchange")[0]


def test_digest_index_compacts_and_looks_up(spark):
    index = exact_dedup.DigestIndex(spark, 100)
    for run in range(6):
        rows = [(bytes([d]) * 32, 10 * run + d, run) for d in range(5)]
        index.ingest(spark.createDataFrame(rows, "digest binary, doc_id long, row_no long"))
    assert len(index.runs) == 6
    found = index.lookup([bytes([3]) * 32]).collect()
    assert [(r.keeper.doc_id, r.copies) for r in found] == [(3, 6)]
    assert {(r.keeper.doc_id, r.copies) for r in index.entries().collect()} == {(d, 6) for d in range(5)}
    assert len(index.runs) == 1


def test_digest_collisions_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "sha2", lambda body, bits: F.lit("00" * 32))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False)}


def test_packing_round_trip(docs, empty):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = packing.op7_packing(docs.drop("bucket"), TOKENIZER).toPandas()
    assert rows.sequence_id.is_unique and (rows.offset == 0).all()
    for i, text in {r[0]: r[1] for r in ROWS if r[0] not in (None, 7)}.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for p in rows[rows.doc_id == i].sort_values("start").itertuples():
            assert p.start == at and p.length & (p.length - 1) == 0 and p.length <= 4096 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert packing.pack(empty, TOKENIZER).count() == 0
    assert packing.piece_lengths(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1]


@pytest.mark.parametrize(
    "text", ["Déjà vu l'été; it's 42%!", "<|endoftext|> x", "a\x01b \x01 c", "ǅ İstanbul ΑΣ ﬁ", "é ́x", "we'll''s ''ve", " 　z\x1cq", "Ⅷ½²"]
)
def test_words_have_the_tokenizer_s_ids(text):
    import pyarrow as pa
    import pyarrow.compute as pc

    words = pc.unique(pc.ascii_split_whitespace(pa.array([text])).flatten())
    ids, first, size = packing.WordIds(TOKENIZER).of(words)
    at = {w: ids[f : f + n].tolist() for w, f, n in zip(words.to_pylist(), first, size)}
    expected = Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids
    assert [x for w in re.split(r"[ \t-\r]+", text) if w for x in at[w]] == expected


def test_mixing(spark, docs, empty):
    many = spark.createDataFrame([(i, "x" * 100, "en", "hot" if i % 3 else f"s{i % 4}") for i in range(3000)], "doc_id long, text string, lang string, source string")
    out = mixing.mix(many, {"hot": 1.0, "s0": 3.0}, budget=2.0).toPandas()
    share = out.source.value_counts(normalize=True)
    assert abs(share["hot"] - 0.25) < 0.03 and abs(share["s0"] - 0.75) < 0.03 and abs(len(out) - 6000) < 400
    assert set(out.source) == {"hot", "s0"}
    assert out.groupby("doc_id").copy_no.apply(lambda c: sorted(c) == list(range(len(c)))).all()
    again = mixing.mix(many, {"hot": 1.0, "s0": 3.0}, budget=2.0).toPandas()
    assert sorted(map(tuple, out.values)) == sorted(map(tuple, again.values))
    mixing.BROADCAST_SOURCES, most = 0, mixing.BROADCAST_SOURCES  # the way for many sources
    joined = mixing.mix(many, {"hot": 1.0, "s0": 3.0}, budget=2.0).toPandas()
    mixing.BROADCAST_SOURCES = most
    assert sorted(map(tuple, out.values)) == sorted(map(tuple, joined.values))
    assert mixing.mix(docs).columns == [*docs.columns, "copy_no"] and mixing.mix(empty).count() == 0
    assert mixing.mix(docs.withColumnRenamed("fp", "copy_no")).columns[-1] == "copy_no_"


def rules_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_edge_cases(docs, empty, spark):
    texts = [None, "", "a b c", "x " * 40, LONG, "p\nq\np\n\n\n", "\U0001f600 é " * 12, " ".join(map(str, range(20))) + " " + " ".join(map(str, range(5, 14)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality_rules.op5_quality_rules(df).toPandas().set_index("doc_id")
    for i, text in enumerate(texts):
        r = got.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == rules_brute(text), text
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.op5_quality_rules(empty).count() == 0
    order = list(quality_rules.rules(df.text, quality_rules.words(df.text)))
    verdicts = [{r.doc_id: r.first_failed is None for r in quality_rules.judge(df, o).collect()} for o in (order, order[::-1])]
    assert verdicts[0] == verdicts[1]
    assert "first_failed" in quality_rules.judge(docs).columns


def test_langid_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op4_langid(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_langid_edge_cases(docs, empty):
    got = {r.doc_id: r for r in langid.op4_langid(docs).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[6].lang_pred == "und" and got[3].score == 0
    assert got[8].lang_pred in ("de", "en")
    assert langid.op4_langid(empty).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {1, 8} <= {r.doc_id for r in kept.collect()} and 3 not in {r.doc_id for r in kept.collect()}


PAGES = [
    ("<html><head><title>t</title></head><body><nav><a>Home</a></nav><article><h1>A &amp; B</h1><p>One<br>two<p><b>three</article><footer>f</footer>", "A & B One two three"),
    ("<body><div class='cookie-notice'>We use cookies</div><p>" + "Real words here. " * 9 + "</p><p>End.</p><div id=comments><p>First!</p></div>", "Real words here. " * 9 + "End."),
    ("<script>var t='</p><article>no';</script><main><p>a<!-- <p>x --> b</p><aside>s</aside><form>f</form><p>c</p></main>", "a b c"),
    (None, ""),
    ("", ""),
    ("<article><p class=notice>n<p>a</p><p>b</article><aside><article>related</article></aside>", "a b"),
    ("<nav><ul><li>x<article><p>a</p></article>", "a"),
    ("<body><nav>Home</nav><div><p>Short one.</p></div><footer>f</footer>", "Short one."),
    ("<article><p>cut of", "cut of"),
    ("<article><p>1 < 2 &lt;b&gt; &#233;&nbsp;x</p></article><article class='comment'>no</article>", "1 < 2 <b> é x"),
]


def test_html(spark):
    pages = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.op3_html(pages).collect()}
    for i, (_, text) in enumerate(PAGES):
        assert got[i].text == text and got[i].n_chars == len(text)
    assert html_text.op3_html(pages.limit(0)).count() == 0


def test_toxicity(spark, docs, labels, empty):
    rng = np.random.default_rng(1)
    rows, marks = [], []
    for i in range(600):
        words = [f"w{x}" for x in rng.integers(0, 300, 40)]
        toxic = i % 4 == 0
        if toxic:
            words[5:5] = ["you", "are", "a", ("idiot", "gruffel", "blorken")[i % 3]]
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.op8_toxicity(d, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).toPandas().set_index("doc_id")
    truth = pd.Series({i: t for i, _, t in marks})
    assert (got.predicted == truth.loc[got.index]).mean() > 0.98 and got.score.between(0, 1).all()
    assert toxicity.op8_toxicity(docs, labels).count() == len(ROWS) and toxicity.op8_toxicity(empty, labels).count() == 0
    score = toxicity.scorer({})
    assert sum(score("you are an idiot.")[:1]) > sum(score("not an idiot.")[:1]) == 0 < score("not an idiot.")[1]


def spans_brute(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii_base_spans_against_plain_patterns():
    rng = np.random.default_rng(5)
    alphabet = list("ab@..--+ 01234567899()_%é\n")
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(1, 60)))
        assert pii.base_spans(text) == spans_brute(text), text


def test_pii(spark, docs, empty):
    texts = ["mail a.b@c.de or +1 (415) 555-0100", "card 4111 1111 1111 1111, ip 10.0.0.255 not 10.0.0.256", "call me: phone (415) 555-0199.", None, "order no 415-555-0100x", "ssn: 123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.op9_pii(df).collect()}
    assert got[0].n_email == 1 and got[0].n_phone == 1 and got[0].spans.startswith("email:5:13,phone:17:")
    assert got[1].n_card == 1 and got[1].n_ip == 1
    assert "national_phone:" in got[2].spans and got[3].spans == "" and "identity:5:16" in got[5].spans
    assert pii.op9_pii(docs).count() == len(ROWS) and pii.op9_pii(empty).count() == 0


def test_quality_model(spark, docs, labels, empty):
    sf = "/root/testdata/sf0.01"
    got = Q.op2_quality(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id", suffixes=("", "_label"))
    assert ((got.quality >= 0.5) == got.quality_label).mean() > 0.97
    assert quality_model.op2_quality(docs, labels).count() == len(ROWS) and quality_model.op2_quality(empty, labels).count() == 0


def test_sampled_classes_keep_the_table_s_shares(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    rows, marks = [], []
    for i in range(3000):
        bad = i % 10 == 0
        words = [f"w{x}" for x in rng.integers(0, 50, 12)]
        if rng.random() < (0.5 if bad else 0.1):
            words[3:3] = ["you", "idiot", "|", "|"]
        rows.append((i, " ".join(words), "s", "en"))
        marks.append((i, int(not bad), int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    m = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for size in (10_000, 200):  # all rows, and samples of one to one
        model = toxicity.fit(d, m, F.lit(True), size)
        assert abs(toxicity.score(d, model).agg(F.avg("score")).first()[0] - 0.1) < 0.03
        monkeypatch.setattr(quality_model, "SAMPLE", size)
        assert abs(quality_model.op2_quality(d, m).agg(F.avg("evidence")).first()[0] - 0.9) < 0.03
