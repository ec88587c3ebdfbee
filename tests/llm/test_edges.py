"""Hard cases of the operators: empty tables, repeats, nulls, long texts, clashing columns, groups."""

import random
import zlib

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

pytest.importorskip("candlework.llm")
from candlework.llm import ann, chat, mixing, packing, quality, simhash, suffix, token_files, urls  # noqa: E402
from candlework.llm.common import slices  # noqa: E402
from candlework.llm.tokens import Encoder, public_path  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, copies int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, 1) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_a_fresh_tokenizer(name):
    from tokenizers import Tokenizer

    given = ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["text"]).column("text").to_pylist()
    given += [None, "", "\n", "a <|endoftext|> b", "<|ENDOFTEXT|>x", "a\nb\n\nc", " lead", "trail ", "a  b", "\ta", "x y", "it's '́x \x01 a", "\x1c a", "don't. 12's a_b ½"]
    plain = Tokenizer.from_file(public_path(name))
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch([t or "" for t in given], add_special_tokens=False)]
    assert Encoder(public_path(name)).encode(given) == want
    small = Encoder(public_path(name), cache_words=500)
    assert [x for i in range(0, len(given), 50) for x in small.encode(given[i : i + 50])] == want
    as_text = Encoder(public_path(name), special_as_text=True).encode(["a <|endoftext|> b"])[0]
    assert len(as_text) > len(Encoder(public_path(name)).encode(["a <|endoftext|> b"])[0])


def test_slices_are_bounded():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "", "y" * 100, "z"])], names=["text"])
    assert [p.num_rows for p in slices(batch, rows=2, size=50)] == [2, 1, 1, 1] and not list(slices(batch.slice(0, 0)))


def test_mixing_takes_as_many_equal_rows_as_are_owed(spark):
    rows = [(1, "w " * 10, "a")] * 302 + [(1000 + i, "w " * (10 + i % 7), "b") for i in range(300)] + [(5000, "w " * 9, "c")] * 10 + [(None, "x y", None)] * 3
    df = table(spark, rows)
    got = mixing.mix(df).collect()
    taken, targets = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        targets[r.source] = r.target
        assert 0 <= r.copies <= 3
    assert len(got) == len(rows) and all(abs(taken[s] - targets[s]) <= 8 for s in targets)
    out = mixing.mixed(df).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in out} == {s: sum(r.copies for r in got if r.source == s) for s in taken}


def test_mixing_against_its_definition(spark):
    """A plain second version: the same random order, greedy with the same passes and closing pick."""
    draw = random.Random(4)
    rows = [(i, "w " * draw.randint(1, 30), draw.choice("ab")) for i in range(200)]
    df = table(spark, rows)
    ranks = {r.doc_id: r.u for r in df.select("doc_id", mixing.uniform(F.col("doc_id")).alias("u")).collect()}
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    for s in "ab":
        own = sorted((ranks[i], i, len(t.split())) for i, t, x in rows if x == s)
        target = got[own[0][1]].target
        whole = int(target / sum(n for *_, n in own) + 1e-12)
        left, picked = target - whole * sum(n for *_, n in own), set()
        for _ in range(mixing.PASSES):
            start = left
            for _, i, n in own:
                if i in picked or n > start:
                    continue
                if n > left:
                    break
                picked.add(i)
                left -= n
        rest = [(abs(n - left), u, i) for u, i, n in own if i not in picked and abs(n - left) < left]
        picked |= {min(rest)[2]} if rest else set()
        assert {i for _, i, _ in own if got[i].copies > whole} == picked


def brute_roots(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if simhash.similarity(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(texts))}


def test_one_document_of_each_group_stays(spark):
    draw = random.Random(9)
    words = ["".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    texts = []
    for _ in range(4):
        base = [draw.choice(words) for _ in range(80)]
        for _ in range(30):
            own = base[:]
            for k in draw.sample(range(80), draw.choice((0, 0, 1, 2, 4, 8))):
                own[k] = draw.choice(words)
            texts.append(" ".join(own))
    texts += ["", None, "  ", "one two", "One  TWO"]
    df = table(spark, [(i, t, "a") for i, t in enumerate(texts)])
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == brute_roots(texts)


def test_a_base_with_any_id_joins_its_copies(spark):
    draw = random.Random(12)
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    base, copies = [draw.choice(words) for _ in range(400)], []
    for _ in range(25):
        own = base[:]
        for k in draw.sample(range(400), 7):
            own[k] = draw.choice(words)
        copies.append(" ".join(own))
    texts = copies + [" ".join(base)]  # the copies are like the base and not like each other
    kept = simhash.one_of_each(table(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    assert [r.doc_id for r in kept] == [0] and brute_roots(texts) == {0}


def test_groups_of_odd_rows(spark):
    assert simhash.one_of_each(table(spark, [])).count() == 0
    rows = [(None, "a b c d e f g", "a"), (None, "a b c d e f g", "a"), (5, "a b c d e f g", "a"), (5, "a b c d e f g", "a"), (5, "other words in it all", "a"), (9, "A b c d e f g", "b"), (11, "other words in it all", "c")]
    kept = simhash.one_of_each(table(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == [(-1, "a b c d e f g")] * 2 + [(5, "a b c d e f g")]


def test_sketches_estimate_similarity():
    draw = random.Random(5)
    worst = 0.0
    for n in (30, 200, 3000):
        for _ in range(40):
            base = [str(draw.randrange(10**7)) for _ in range(n)]
            own = base[:]
            for k in draw.sample(range(n), max(1, n // 40)):
                own[k] = "x"
            a, b = " ".join(base), " ".join(own)
            pair = [np.frombuffer(simhash.sketch(t), np.uint8)[None] for t in (a, b)]
            true = simhash.similarity(a, b)
            worst = max(worst, abs(simhash.estimate_pairs(*pair)[0] - true))
            assert abs(simhash.estimates(*map(simhash.folded, pair))[0, 0] - true) < simhash.COARSE_SLACK
    assert worst < simhash.SKETCH_SLACK


def test_packing_of_lengths_that_never_fill(spark):
    draw = random.Random(2)
    rows = [(i, 0, 0, 3 * draw.randint(1, 30), i) for i in range(3000)]
    items = spark.createDataFrame(rows, packing.PIECES)
    got = packing.pack(items, 100, group_rows=300)
    filled = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert got.count() == 3000 and max(r.n for r in filled) <= 100
    assert len(filled) <= 1.02 * packing.best_fit_decreasing(np.array([r[3] for r in rows]), 100)[1] + 1


def test_packing_repeats_and_null_ids(spark):
    rows = [(None, "some words here", "a"), (None, "some words here", "a"), (3, "some words here", "a"), (3, "some words here", "a")]
    got = packing.pack(packing.pieces(table(spark, rows))).collect()
    assert len(got) == 4 and sorted(r.offset for r in got) == [i * got[0].length for i in range(4)] and len({r.sequence_id for r in got}) == 1


def test_small_packings_are_near_the_optimum():
    draw = random.Random(7)

    def best(sizes, room):
        if not sizes:
            return len(room)
        x, *rest = sizes
        tried, out = set(), best(rest, [*room, 10 - x])
        for i, r in enumerate(room):
            if r >= x and r not in tried:
                tried.add(r)
                out = min(out, best(rest, [*room[:i], r - x, *room[i + 1 :]]))
        return out

    for _ in range(40):
        sizes = sorted((draw.randint(1, 10) for _ in range(7)), reverse=True)
        found = packing.best_fit_decreasing(np.array(sizes), 10)[1]
        assert packing.bin_bound(np.array(sizes), 10) <= best(sizes, []) <= found <= best(sizes, []) + 1


def test_token_files_of_odd_tables(spark, tmp_path):
    token_files.write(token_files.tokens(table(spark, [])), str(tmp_path / "none"))
    assert token_files.read_back(spark, str(tmp_path / "none")).count() == 0
    rows = [(4, "same words", "a")] * 50 + [(None, "no id", "a"), (2, None, "b")]
    toks = token_files.tokens(table(spark, rows)).withColumn("tie", F.monotonically_increasing_id())
    token_files.write(toks, str(tmp_path / "set"), block_tokens=20, shard_tokens=30)
    got = sorted(token_files.read_back(spark, str(tmp_path / "set")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 2] + [4] * 50
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert got[1].ids_crc32 == zlib.crc32((2).to_bytes(4, "little")) and len({r.ids_crc32 for r in got[2:]}) == 1


def test_neighbours_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, key string"
    none = spark.createDataFrame([], schema)
    assert ann.search(none, none.select("vec_id")).count() == 0
    rows = [(i, [float(i % 7 + 1), 1.0], "x") for i in range(40)] + [(3, [4.0, 1.0], "x")] * 2 + [(None, [1.0, 1.0], "x"), (50, [1.0, None], "x"), (51, [1.0, 2.0, 3.0], "x"), (52, [], "x"), (53, [float("inf"), 1.0], "x")]
    df = spark.createDataFrame(rows, schema)
    got = ann.search(df, df.where("vec_id % 20 = 0").select("vec_id")).collect()
    want = sorted((-(i % 7 + 1.0) - 1.0, i) for i in range(1, 40))[:20]
    assert [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [(-s, i) for s, i in want]


def test_index_finds_all_codes_within_the_radius_and_prunes_clusters():
    draw = np.random.default_rng(3)
    for spread, most in ((0.3, 0.6), (5.0, 1.0)):
        x = draw.normal(size=(100, 64))[draw.integers(0, 100, 6000)] + spread * draw.normal(size=(6000, 64))
        mean, projection = ann.learn_rotation(x[: ann.SAMPLE])
        code, centred = ann.codes(x, mean, projection), x - mean
        centred /= np.sqrt((centred**2).sum(axis=1, keepdims=True))
        index, share = ann.Index(code), []
        for q in range(40):
            found, scores, visited = index.search(int(code[q]), ann.scorer(x, x[q]), lambda i: centred[i] @ centred[q], 21)  # noqa: B023
            distance = np.bitwise_count(code ^ code[q])
            assert len(set(found.tolist())) == len(found) >= 21 and np.allclose(scores, x[found] @ x[q])
            assert set(np.flatnonzero(distance <= distance[found].max())) == set(found.tolist())
            share.append((visited / len(x), len(found) / len(x)))
        seen, scored = np.mean(share, axis=0)
        print(f"spread {spread}: visited {seen:.3f}, scored {scored:.3f}")
        assert seen <= most and (scored < 0.2 or spread > 1)


def test_neighbours_of_shards_and_common_lengths(spark, monkeypatch):
    """Just over 1,000 vectors, in several shards and blocks; two lengths as common: the shorter; copies keep their ids."""
    monkeypatch.setattr(ann, "SHARD", 300)
    monkeypatch.setattr(ann, "BLOCK", 8)
    x = np.random.default_rng(8).normal(size=(1001, 24))
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(2000 + i, [1.0] * 25) for i in range(1001)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 20 = 0").select("vec_id")).collect()
    assert {r.query_id for r in got} == set(range(0, 1001, 20)) and max(r.vec_id for r in got) < 1001
    hits = 0
    for q in range(0, 1001, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.9 * 20 * 51


def test_url_scores_against_python(spark):
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").limit(200)
    weights = [((i * 37) % 101 - 50) / 10 for i in range(urls.BUCKETS + 1)]
    x = urls.grams(*urls.host_and_path(F.col("url")))
    for r in pages.select(x.alias("x"), urls.score(x, weights).alias("s")).collect():
        assert r.s == pytest.approx(weights[-1] + sum(weights[b] for b in r.x) / max(1, len(r.x)) ** 0.5)


def test_urls_of_odd_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, host string")
    assert urls.judge(none, urls.train([])).count() == 0 and urls.labelled(none).count() == 0
    many = spark.createDataFrame([(i, "http://example.com/en/1", "x") for i in range(300)] + [(400, "http://b.com/x", "y"), (401, None, None)], "page_id long, url string, host string")
    assert sorted(r.y for r in urls.labelled(many).collect()) == [0, 1]
    got = urls.judge(many, urls.train([(list(r.x), r.y) for r in urls.labelled(many).collect()]))
    assert got.count() == 302 and got.columns == ["page_id", "host", "path", "rule", "verdict"]


def test_chats_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, n long"
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, i, "user", f"t{i}", 5) for i in range(600)] + [(2, i, "user", f"t{i}", 5) for i in range(599)] + [(3, 0, "user", "q", 1), (3, 0, "user", "q", 1)]
    got = {r.conv_id: r.n_turns for r in chat.format_chats(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: 600, 3: 2}


def test_suffixes_of_a_very_long_text_and_repeats(spark):
    draw = random.Random(8)
    long = "".join(draw.choice("abcdefghij ") for _ in range((1 << 19) + 5000))
    tail = long[-3000:-1000]  # across the seam of the blocks that are hashed together
    rows = [(1, long, "a"), (None, "x" + tail + "y", "a"), (7, "short", "a"), (7, "short", "a"), (8, "z" * 300, "a")]
    got = {(r.doc_id, r.n_bytes): r for r in suffix.remove_repeats(table(spark, rows)).collect()}
    assert got[(1, len(long))].n_removed == 2000 and got[(None, 2002)].n_removed == 2000
    assert got[(7, 5)].n_removed == 0 and got[(8, 300)].n_removed == 300
    assert suffix.clean_texts(table(spark, [])).count() == 0


def test_quality_measures(spark):
    texts = [None, "", "a # b\nc", "| w * $", "ok words are here for us to read now and then", "same line here\nsame line here\nsame line here\nsame line here"]
    rows = quality.judge(table(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.word_chars == sum(map(len, t.split())) and r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        kept = not any(rule(quality.Text(t)) for rule in quality.RULES.values())
        assert r.kept == kept
    assert [r.doc_id for r in quality.keep(table(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()] == [r.doc_id for r in rows if r.kept]


def test_neighbour_tasks_send_no_vectors(spark):
    """A result row of a task held a copy of its query's vector; long vectors and repeats stay exact without."""
    draw = np.random.default_rng(4)
    x = draw.normal(size=(120, 300)).astype(np.float32)
    x[60:90] = x[5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    found = ann.search(df, df.where("vec_id % 20 = 0").select("vec_id"))
    plan = found._jdf.queryExecution().analyzed().toString()
    ran = [line for line in plan.splitlines() if "FlatMapCoGroupsIn" in line]
    assert ran and all("vec_ids" in line and not line.split("[")[-1].startswith("v#") and ", v#" not in line.split("[")[-1] for line in ran)
    y = x.astype(np.float64)
    for q in range(0, 120, 20):
        score = (y * y[q]).sum(axis=1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(120), -score))[:20].tolist()
        mine = sorted((r.rank, r.vec_id, r.score) for r in found.collect() if r.query_id == q)
        assert [v for _, v, _ in mine] == best and [s for _, _, s in mine] == score[best].tolist()


def test_near_dedup_searches_fingerprints_by_trees(spark, monkeypatch):
    """Pairs come from vantage-point trees over SimHash parts: all that are near on a part, whoever else is there."""
    draw = np.random.default_rng(7)
    base = draw.integers(0, 256, (900, 8 * simhash.WORDS), np.uint8)
    base[300:600] = base[:300] ^ np.packbits(draw.random((300, 64 * simhash.WORDS)) < 0.15, axis=1)
    base[600:700] = base[0]
    sig = base.view(np.uint64)
    bits = np.bitwise_count(sig[:, None] ^ sig[None]).sum(axis=2)
    near = (np.bitwise_count(base.view(np.uint16)[:, None] ^ base.view(np.uint16)[None]) <= simhash.WIDE_REACH).any(axis=2) & (bits <= simhash.WIDE_RADIUS)
    grown, grow = [], simhash.grow
    monkeypatch.setattr(simhash, "grow", lambda *a: grown.append(1) or grow(*a))
    points = spark.createDataFrame([(i, 5, i, bytes(r)) for i, r in enumerate(base)], "node long, tag long, root long, sig binary")
    want = {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}
    for shard in (64, 1 << 16):
        got = simhash.candidates(points, None, shard=shard).collect()
        assert {(min(r.u, r.v), max(r.u, r.v)) for r in got} == want and len(grown) >= simhash.WIDE_PARTS
        grown.clear()
    one = simhash.candidates(points, 0).collect()
    missed = want - {(min(r.u, r.v), max(r.u, r.v)) for r in one if r.v is not None}
    assert {i for pair in missed for i in pair} <= {r.u for r in one if r.v is None}
    texts = [" ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(63)), "x y z"]
    kept = simhash.one_of_each(table(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2] and len(grown) >= simhash.WIDE_PARTS


def test_wide_fingerprints_lose_few_similar_texts():
    draw, total, lost = random.Random(3), 0, 0
    for n in (12, 40, 400):
        for _ in range(150):
            base = [str(draw.randrange(10**6)) for _ in range(n)]
            own = base[: n - max(1, n // 12)] + ["x"] * (n // 60) + ["y"]
            a, b = " ".join(base), " ".join(own)
            if simhash.similarity(a, b) < 0.8:
                continue
            p, q = (np.frombuffer(simhash.wide_fingerprint(t), np.uint16) for t in (a, b))
            bits = np.bitwise_count(p ^ q)
            total, lost = total + 1, lost + (bits.min() > simhash.WIDE_REACH or bits.sum() > simhash.WIDE_RADIUS)
    assert total > 100 and lost == 0


def test_near_copies_below_the_limit_are_not_judged_pair_by_pair(spark, monkeypatch):
    """A large group of near-copies, each with words of its own: few pairs are made, and those that are similar are linked."""
    draw = random.Random(21)
    base, texts = [f"w{draw.randrange(10**6)}" for _ in range(150)], []
    for i in range(240):
        own = base[:]
        for k in draw.sample(range(150), 1 if i % 40 == 0 else 3):
            own[k] = f"x{draw.randrange(10**6)}"
        texts.append(" ".join(own))
    made, spool = [], simhash.spool

    def counted(df, name):
        out = spool(df, name)
        if name == "candidates":
            made.append(out.where("v is not null").count())
        return out

    monkeypatch.setattr(simhash, "spool", counted)
    kept = {r.doc_id for r in simhash.one_of_each(table(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert kept == brute_roots(texts) and 1 < len(kept) < 240
    assert sum(made) < 30 * len(texts), made


def test_tallies_rule_out_no_similar_pair():
    draw, some, ruled = random.Random(8), 0, 0
    pairs = [(" ".join(map(str, range(n))), " ".join(map(str, range(m)))) for n, m in ((8, 9), (84, 104), (804, 1004), (805, 1005), (3, 3), (0, 3))]
    long = " ".join(map(str, range(80_000)))
    pairs += [(long, long + " x y"), (long, " ".join(map(str, range(64_004)))), (long, "1 2 3 4 5 6")]
    for n in (20, 150, 1500):
        for _ in range(60):
            base = [str(draw.randrange(10**6)) for _ in range(n)]
            a, b = base[:], base[:]
            for own in (a, b):
                for k in draw.sample(range(n), draw.randrange(max(2, n // 30))):
                    own[k] = "x" + str(draw.randrange(10**6))
            pairs.append((" ".join(a), " ".join(b)))
    for a, b in pairs:
        x, y = (np.frombuffer(simhash.tally(t), np.uint8)[None] for t in (a, b))
        n, m = (np.array([len(simhash._shingle_set(t, 5))]) for t in (a, b))
        true, may = simhash.similarity(a, b) >= 0.8, bool(simhash.possible(x, y, n, m, 0.8)[0])
        assert may or not true
        some, ruled = some + true, ruled + (not may)
    assert some > 20 and ruled > 20


def test_parts_are_searched_a_few_at_a_time(spark, monkeypatch):
    """The points on their way to tasks take disk for a few parts only; the pairs stay the same."""
    draw = np.random.default_rng(17)
    base = draw.integers(0, 256, (300, 8 * simhash.WORDS), np.uint8)
    base[150:] = base[:150] ^ np.packbits(draw.random((150, 64 * simhash.WORDS)) < 0.15, axis=1)
    points = spark.createDataFrame([(i, 5, i, bytes(r)) for i, r in enumerate(base)], "node long, tag long, root long, sig binary")
    written, spool = [], simhash.spool
    monkeypatch.setattr(simhash, "spool", lambda df, name: written.append(name) or spool(df, name))
    for most in (0, None):
        whole = simhash.candidates(points, most).collect()
        assert not written
        some = simhash.candidates(points, most, flight=8 * 300).collect()
        assert written == ["found"] * 4 and set(some) == set(whole) and len(some) == len(whole) > 100
        written.clear()
