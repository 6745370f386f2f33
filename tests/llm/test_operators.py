"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties and clashing names."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import html, language, linededup, minhash, mixing, neighbours, packing, passages, tokens, vectors
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, bucket string, class_id string, _t string"
RNG = np.random.default_rng(3)
VOCABULARY = ["".join(RNG.choice(list("abcdefghijklmnoprstuvz"), RNG.integers(2, 9))) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


BASE = prose(200, 1)
NEAR = BASE.replace(BASE.split()[20], "changed", 1)
PASSAGE = prose(60, 9)
TEXTS = [
    None, "", " \t\n ", "one", "four small words here", BASE, BASE, BASE.upper(), NEAR, prose(200, 2), prose(5000, 3),
    f"{prose(80, 4)} {PASSAGE} {prose(80, 5)}", f"{prose(30, 6)} {PASSAGE} {prose(90, 7)}", "Straße ñandú 漢字 été\u0085x\x1cy <|endoftext|> don't  two\n\n three \n",
    "SHARED line\nown " + prose(30, 8), "123 456 !!!", "x" * 5000,
] + [f"  shared LINE \t\nown {i} {prose(20, 100 + i)}\n\nend" for i in range(12)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "a", "b", "c"][i % 4], None, "k", 1, "b", "c", "t") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id at all " + prose(20, 50), "en", "a", None, "k", 1, "b", "c", "t")], SCHEMA)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_token_counts(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, path).collect()}
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (i, len((t or "").encode()), n, n > 1024) in got
    assert tokens.count_tokens(nothing, path).count() == 0


def test_whole_tokens_are_proved():
    own = tokens.counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(own.whole) > 30_000
    assert all(own.merged(s) == 1 for s in list(own.whole)[:500])


def test_packing(docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, 256).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    for i, t in enumerate(TEXTS):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
        assert sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i}) == want
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(nothing, path).count() == 0


def test_bin_completion_beats_best_fit():
    sizes = [6, 5, 4, 3, 2] * 2 + [7, 3]  # best fit decreasing may need one more than the bound
    bins = packing.complete_bins(sizes, 10)
    assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= 10 for b in bins) and len(bins) == 5
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = rng.integers(1, 60, rng.integers(1, 40)).tolist()
        bins = packing.complete_bins(sizes, 100)
        assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= 100 for b in bins)
        assert packing.lower_bound(packing.Counter(sizes), 100) <= len(bins) <= len(packing.best_fit(sizes, 100))


def test_near_duplicates(docs, nothing):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, 85).collect()}
    want = brute.near_components(list(enumerate(TEXTS)), 85)
    assert {i: got[i].component_id for i in want} == want
    assert {i: got[i].n_shingles for i in want} == {i: len(brute.shingles(t)) for i, t in enumerate(TEXTS)}
    assert got[None].component_id is None and not got[None].kept and got[5].kept and not got[8].kept
    assert minhash.near_duplicates(nothing, 85).count() == 0
    stay = sorted(r.doc_id for r in minhash.keep_one(docs, 85).where("doc_id is not null").collect())
    assert stay == sorted(i for i, c in want.items() if i == c or not brute.shingles(TEXTS[i]))


def test_a_large_group_of_near_copies(spark):
    words = prose(150, 77).split()
    texts = []
    for i in range(60):
        rng, w = np.random.default_rng(1000 + i), list(words)
        for p in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            w[p] = f"edit{i}x{p}"
        texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 85).collect()}
    assert got == brute.near_components(list(enumerate(texts)), 85)


def test_line_dedup(docs, nothing):
    got = {r.row.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(brute.ASCII)
    for i, t in enumerate(TEXTS):
        lines = (t or "").split("\n")
        kept = [x for x in lines if strip(x) != "shared line" and strip(x) != "end"]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    first = {r.row.doc_id: r.n_dropped for r in linededup.dedup_lines(docs, keep_first=True).collect()}
    assert first[14] == 0 and first[17] == 1 and first[18] == 2
    assert linededup.dedup_lines(nothing).count() == 0


def test_mixing(docs, nothing):
    rows = mixing.mixture(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    by: dict = {}
    for r in rows:
        by.setdefault(r.skey, []).append(r)
    total = sum(r.size for r in rows)
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        assert sum(r.taken for r in v) == round(v[0].target) and v[0].target <= 2 * v[0].source_size
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixture(docs.repartition(5)).collect()))
    assert mixing.mixture(nothing).count() == 0 and mixing.mix(docs).columns == docs.columns


def test_language(docs, nothing, spark):
    assert language.identify(nothing).count() == 0
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 15)) and got[5].lang_pred != "und"
    syllables = {"en": "the ing ed er th wh", "de": "sch ung ein der ich", "fr": "eau oi que les eux", "es": "ción os el que ñ ar"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(syllables[k].split(), 40)), k) for i, k in enumerate(list(syllables) * 60)]
    said = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    assert len(said) > 30 and sum(r.lang_pred == rows[r.doc_id][2] for r in said) >= 0.97 * len(said)


def test_the_training_sample_is_bounded(spark):
    """Rows of null or repeated ids are told apart by text; equal rows count once."""
    same = [(None, f"text {i}", "en") for i in range(300)] + [(1, f"texte {i}", "fr") for i in range(300)] + [(None, "hola", "es")] * 3000
    sample = language.training_sample(spark.createDataFrame(same, "doc_id long, text string, lang string"), 20).collect()
    assert {k: sum(r.lang == k for r in sample) for k in ("en", "fr", "es")} == {"en": 20, "fr": 20, "es": 1}


def test_unlabelled_documents_stay(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    df = spark.createDataFrame([(1, "clean text", None), (2, "123", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, df, "").collect()] == [1]


def test_passages(docs, nothing):
    rows = passages.repeated_passages(docs).collect()
    own = {(r.doc_id, r.kept_doc_id): r for r in rows}
    assert own[(12, 11)].n_words >= 60 and own[(12, 11)].start == 30
    assert {r.doc_id for r in rows} == {6, 7, 8, 12}
    assert passages.repeated_passages(nothing).count() == 0


def test_passages_behind_a_shorter_excerpt(spark):
    """Documents that share more than the bucket's least one has: an excerpt too short to count, or one that ends before."""
    texts, wanted = [], {}
    for k in range(8):
        passage, at = prose(60, 500 + k), 4 * k
        words = passage.split()
        head = " ".join(words[:50] if k % 2 else words[:52])
        again = f" {prose(20, 700 + k)} {head}" if k % 4 == 1 else ""
        texts += [(at, head + again), *[(at + i, f"{prose(40, 600 + 4 * k + i)} {passage} {prose(40, 800 + 4 * k + i)}") for i in (1, 2, 3)]]
        wanted |= {at + i: at + k % 2 for i in range(1 + k % 2, 4)}
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    # the first document behind an excerpt of 52 words repeats only these
    assert {i: r.kept_doc_id for i, r in got.items()} == wanted
    assert all(r.start <= 40 and r.end >= (92 if i % 8 == 1 else 100) for i, r in got.items())


def test_passages_of_common_phrases(spark):
    """A passage whose every phrase stands in many other documents, too, is found as it is without them."""
    phrases = [prose(12, 20000 + k) for k in range(6)]
    passage = lambda i: " ".join(f"{phrase} differs{i}x{k}" for k, phrase in enumerate(phrases)).rsplit(" ", 1)[0]
    pair = [(i, f"{prose(50, 20100 + i)} {passage(i)} {prose(30, 20200 + i)}") for i in (1, 2)]
    others = [(10 + 40 * k + i, f"{prose(40, 21000 + 40 * k + i)} {phrase} {prose(40, 22000 + 40 * k + i)}") for k, phrase in enumerate(phrases) for i in range(40)]
    for texts in (pair, pair + others, others[:120] + [(900 + i, text) for i, text in pair] + others[120:]):
        got = [tuple(r) for r in passages.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
        two, one = sorted((i for i, text in texts if text in {pair[0][1], pair[1][1]}), reverse=True)
        assert got == [(two, 50, 127, 77, one)]


def test_places_that_can_meet(spark):
    """Four equal words around a shingle make a paragraph; a least document with several places may meet at any."""
    rows = [(1, 0, 5, 7, 0x12345678), (2, 0, 5, 7, 0x12345678), (3, 0, 5, 7, 0x12F4F6F8), (4, 0, 5, 7, 0x12F456F8), (5, 0, 5, 7, 0x0FF40F78), (1, 0, 5, 8, 0), (1, 0, 9, 8, 0x11111111), (2, 0, 5, 8, 0x11111111)]
    bands = spark.createDataFrame(rows, "d long, t long, start int, bucket long, around int")
    got = {(r.bucket, r.d): r.meets for r in passages._after_least(bands).collect()}
    assert got == {(7, 2): True, (7, 3): False, (7, 4): False, (7, 5): False, (8, 2): True}
    words = np.arange(100, 120, dtype=np.uint64)
    around = passages.words_around(words, np.array([0, 7, 14])).view(np.uint32).tolist()
    bits = [int(w) & 15 for w in words]
    side = lambda at: sum(bits[i] << 4 * k for k, i in enumerate(at))
    assert around == [side([6, 7, 8, 9]) << 16, side([6, 5, 4, 3]) | side([13, 14, 15, 16]) << 16, side([13, 12, 11, 10])]


def test_places_that_can_be_in_a_passage(spark):
    """A phrase in many documents with nothing else in common makes no bucket; a passage's runs of eight words keep its places."""
    phrase, passage = prose(20, 30000), prose(51, 30001).split()
    texts = [(i, f"{prose(60, 30100 + i)} {phrase} {prose(60, 30200 + i)}") for i in range(30)]
    changed = [w if k not in (10, 19, 28, 37) else f"changed{k}" for k, w in enumerate(passage)]
    texts += [(100 + i, f"{prose(40, 30300 + i)} {' '.join(p)} {prose(40, 30400 + i)}") for i, p in enumerate((passage, changed))]
    docs = spark.createDataFrame([(i, 0, t) for i, t in texts], "d long, t long, text string")
    got = {}
    for r in passages.possible_places(docs).collect():
        got.setdefault(r.d, set()).add(r.bucket)
    assert set(got) == {100, 101} and got[100] & got[101]
    # one place stands for several of a run of one word
    words = np.r_[np.arange(1, 61), np.full(80, 7), np.arange(200, 260)].astype(np.uint64)
    _, place, _, _ = passages.text_places(words, np.array([0, len(words)]))
    assert 2 < sum(int(p) & 2 > 0 for p in place) < 20


def test_passages_against_all_windows(spark):
    """Every 51-word window that an earlier document has is in a span; short, repetitive and changed passages too."""
    texts = []
    for k in range(150):
        passage = prose(51 + k % 5, 1000 + k)
        texts += [f"{prose(30 + k % 7, 2000 + 2 * k + i)} {passage} {prose(25, 4000 + 2 * k + i)}" for i in (0, 1)]
    for k, part in enumerate(("la ", "la li lu ", "one two three four five six seven eight nine ten ")):
        texts += [f"{prose(20, 5000 + 2 * k + i)} {' '.join((part * 60).split()[:60])} {prose(20, 6000 + 2 * k + i)}" for i in (0, 1)]
    got: dict = {}
    for r in passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    seen: dict = {}
    for i, text in enumerate(texts):
        words = text.split()
        for at in range(len(words) - 50):
            if seen.setdefault(tuple(words[at : at + 51]), i) != i:
                assert any(s <= at and at + 51 <= e for s, e in got.get(i, [])), (i, at)
    assert set(got) == set(range(1, len(texts), 2))
    # four single words differ in each passage of 51, wherever eight equal ones are between them
    rng, pairs = np.random.default_rng(8), []
    for k in range(150):
        words = prose(51, 7000 + k).split()
        first = f"{prose(20, 8000 + k)} {' '.join(words)} {prose(20, 9000 + k)}"
        gaps = 8 + rng.multinomial(7, [0.2] * 5)
        for j, at in enumerate(np.cumsum(gaps)[:4] + np.arange(4)):
            words[at] = f"changed{k}x{j}"
        pairs += [(2 * k, first), (2 * k + 1, f"{prose(25, 10000 + k)} {' '.join(words)} {prose(20, 11000 + k)}")]
    want = {2 * k + 1 for k in range(150) if passages.common_runs(*[np.array([hash(w) for w in pairs[2 * k + i][1].split()]) for i in (1, 0)], [(5, 0)])}
    found = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert len(want) > 20 and found == want


def test_pages(spark):
    page = "<html><head><title>t</title><script>var a='<p>x</p>'</script></head><body><nav><a href=/>Menu</a></nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>One  <b>two</b>\n three.<p>Be.<aside>side</aside></article><div id=comments><p>reader comment that is long enough to look like text, really</div><footer>&copy;</footer>"
    plain = f"<body><ul class=menu><li><a href=a>x</a></ul><div><p>{prose(40, 1)}</p><p>{prose(40, 2)}</p></div><form>Name</form>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", plain), (3, None, None), (4, "u", ""), (5, "u", "<article><p>unclosed <b")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extract_pages(df).collect()}
    assert got[1].text == "A & B\nOne two three.\nBe." and got[1].n_chars == len(got[1].text)
    assert got[2].text == f"{prose(40, 1)}\n{prose(40, 2)}" and got[3].text == got[4].text == ""
    assert html.extract_pages(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 16))
    x = np.vstack([base, base[:40] + 0.05 * rng.standard_normal((40, 16)), np.repeat(base[:1], 30, 0)]).astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [None] + [1.0] * 15, 0), (903, [float("nan")] + [1.0] * 15, 0), (904, [], 0), (905, [1.0, 2.0], 0)]
    return x.astype(np.float64), spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")


def test_near_vectors(embeddings):
    x, df = embeddings
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    components = brute.Union()
    for a, b in zip(*np.nonzero(near), strict=True):
        components.join(int(a), int(b))
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert len(got) == len(x) + 6 and all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 906))
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(len(x))] == [components.root(i) for i in range(len(x))]
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_nearest(embeddings):
    x, df = embeddings
    got: dict = {}
    for r in neighbours.search_inner(df, F.col("vec_id") % 20 == 0, k=20, shard_rows=128).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert not set(got) & {900, 901}
    hits = total = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(len(x)), -s.round(12))) if i != q][:20]
        assert [r for r, _, _ in got[q]] == list(range(1, 21)) and q not in [v for _, v, _ in got[q]]
        assert all(abs(v - s[i]) < 1e-9 for _, i, v in got[q])
        hits, total = hits + len(set(best) & {i for _, i, _ in got[q]}), total + 20
    assert hits >= 0.95 * total
    assert neighbours.search_inner(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_stages(spark, docs):
    """Each stage on the result of the one before, against what it should keep."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(corpus_pipeline.STAGES)
    said = stages["language_id"](spark, docs, "").cache()
    assert said.columns == docs.columns
    assert sorted(r.doc_id for r in said.where("doc_id is not null").collect()) == sorted([i for i, t in enumerate(TEXTS) if any(c.isalpha() for c in t or "")] + [5])
    lines = stages["line_dedup"](spark, said, "").cache()
    assert lines.columns == docs.columns and all(r.n_chars == len(r.text) and "shared" not in r.text for r in lines.where("doc_id > 16").collect())
    near = stages["minhash_near_dedup"](spark, lines, "").cache()
    want = brute.near_components([(r.doc_id, r.text) for r in lines.where("doc_id is not null").collect()], 80)
    assert sorted(r.doc_id for r in near.where("doc_id is not null").collect()) == sorted(set(want.values()))
    mixed = stages["source_mixing"](spark, near, "").cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in near.collect()}
    packed = stages["best_fit_packing"](spark, mixed, "")
    assert packed.where("piece = 0").count() == mixed.count()


def test_lines_of_heavy_keys_and_shared_ids(spark):
    """A line of most documents is dealt in pieces; ids that rows share count once and rows without one don't count."""
    rows = [(i, f"hot\nown {i}\n" + ("warm\n" if i % 40 == 0 else "") + ("rare" if i < 9 else "Hot ")) for i in range(600)]
    rows += [(700, "again")] * 12 + [(None, "again")] * 12 + [(701 + i, "again\nagain") for i in range(8)] + [(None, "HOT\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((-1 if r.row.doc_id is None else r.row.doc_id), r.kept_text, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(df).collect())
    want = []
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if x.strip().lower() not in ("hot", "warm")]
        want.append((-1 if i is None else i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert got == sorted(want)  # "again" is in nine documents with ids
    first = {r.row.doc_id: r.n_dropped for r in linededup.dedup_lines(df, keep_first=True).collect()}
    assert first[0] == 0 and first[1] == 1 and first[9] == 2 and first[40] == 3


def test_lines_are_partitioned_by_range(spark):
    """The windows over line hashes run inside the ranges: nothing is dealt by a hash of them."""
    lines = spark.range(100).selectExpr("id", "false no_id", "id t", "0 p", "id % 7 h1", "id % 5 h2")
    plan = linededup.streamed_lines(lines, spark.createDataFrame([(3, 2)], "h1 long, pieces long"))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "hashpartitioning" not in plan


def test_passages_with_inserted_and_deleted_words(spark):
    """A passage of 60 words with one word more, one less, or two words more stays one passage."""
    texts = []
    for k in range(60):
        words = prose(60, 12000 + k).split()
        other = list(words)
        if k % 3 == 0:
            other.insert(10 + k % 40, "inserted")
        elif k % 3 == 1:
            del other[10 + k % 40]
        else:
            other[15:15], other[40:40] = ["new", "words"], ["more"]
        texts += [f"{prose(20, 13000 + k)} {' '.join(words)} {prose(20, 14000 + k)}", f"{prose(25, 15000 + k)} {' '.join(other)} {prose(20, 16000 + k)}"]
    texts += [texts[0], texts[0]]
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(got) == {*range(1, 120, 2), 120, 121}
    assert all(got[2 * k + 1].start <= 25 and got[2 * k + 1].end >= 84 for k in range(60))
    assert all((got[i].start, got[i].end, got[i].kept_doc_id) == (0, 100, 0) for i in (120, 121))


def test_exact_bin_completion():
    """Without bounds the search finds the optimum, also where best fit and the lower bound miss it."""

    def optimum(sizes, cap):
        best = {0: (1, 0)}  # set of items -> bins, fill of the last one
        for mask in range(1 << len(sizes)):
            if mask in best:
                bins, fill = best[mask]
                for i, s in enumerate(sizes):
                    if not mask >> i & 1:
                        new = (bins, fill + s) if fill + s <= cap else (bins + 1, s)
                        best[mask | 1 << i] = min(best.get(mask | 1 << i, new), new)
        return best[(1 << len(sizes)) - 1][0]

    rng, missed = np.random.default_rng(2), 0
    for _ in range(60):
        sizes = rng.integers(15, 60, 10).tolist()
        bins = packing.complete_bins(sizes, 100, None, None, None)
        assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= 100 for b in bins)
        assert len(bins) == optimum(sizes, 100)
        missed += len(packing.best_fit(sizes, 100)) > len(bins)
    assert missed > 0


def test_packing_over_groups(spark):
    """What the groups leave unfilled is packed again; every piece keeps one gapless place."""
    lengths = np.random.default_rng(5).integers(1, 41, 3000)
    rows = [(None if i == 7 else i, 0, 0, int(n), i) for i, n in enumerate(lengths)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECE), 100, 256).collect()
    assert sorted((r.doc_id or 0, r.length, r.ids_crc32) for r in got) == sorted((d or 0, n, c) for d, _, _, n, c in rows)
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        assert [a for a, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 100
    assert len(by) <= packing.lower_bound(packing.Counter(lengths.tolist()), 100) + 1


def test_a_spread_group_needs_more_leaders(spark):
    """Chains of texts that link only with some of their group, and texts that share a band with none to link."""
    texts = []
    for g in range(12):
        words = prose(220, 900 + g).split()
        for i in range(14):
            w = list(words)
            w[8 * i : 8 * i + 40 : 4] = [f"g{g}x{i}y{j}" for j in range(len(w[8 * i : 8 * i + 40 : 4]))] if i % 3 else w[8 * i : 8 * i + 40 : 4]
            w[200 - 6 * i : 206 - 6 * i : 5] = [f"h{g}x{i}y{j}" for j in range(len(w[200 - 6 * i : 206 - 6 * i : 5]))]
            texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 80).collect()}
    assert got == brute.near_components(list(enumerate(texts)), 80)


def test_texts_in_no_learned_language_go(spark):
    """The model alone rejects texts of another script and of random letters; labelled and held-out documents stay."""
    syllables = {"en": "the ing ed er th wh", "de": "sch ung ein der ich", "fr": "eau oi que les eux", "es": "ción os el que ñ ar"}
    clean = [(i, " ".join(np.random.default_rng(i).choice(syllables[k].split(), 90)), k) for i, k in enumerate(list(syllables) * 60)]
    other = [(1000 + i, "Привет мир как дела сегодня " * 9, None) for i in range(3)] + [(2000, "12 34", "en"), (2001, None, "en")]
    df = spark.createDataFrame(clean + other, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language.keep_identified(df).collect()) == [i for i, _, _ in clean]
    one = spark.createDataFrame([r for r in clean if r[2] == "de"], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(one).collect()} == {"de"} and language.keep_identified(one).count() == 60
