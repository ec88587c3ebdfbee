"""Collocations, spelling variants and license scans against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("candlework.llm")
from candlework.llm import collocations, licenses, spelling  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, word string, n long, words array<int>, hash int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "clash", 5, [1], 3) for i, t, lang in rows], SCHEMA)


# collocations


def prose(seed, n):
    draw = random.Random(seed)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x-y", "delta's", "e", "zz"]
    return "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", "\n", "\r", "!"]) for _ in range(n))


def plain_collocations(rows, least, longest, keep, share):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    counts[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and m >= least and 100 * m >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, m in c.items()):
                continue
            score, cut = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:keep], 1)]
    return sorted(out)


@pytest.mark.parametrize(("longest", "share", "keep"), [(3, 50, 2000), (4, 60, 7)])
def test_collocations(spark, longest, share, keep):
    rows = [(i, prose(i, 150), ("en", None, "und", "fr")[i % 4]) for i in range(12)]
    rows += [(3, None, "en"), (None, "", "en"), (7, " \t", None), (7, rows[0][1], "en"), (7, rows[0][1], "en"), (9, prose(99, 3000), "en")]
    got = collocations.collocations(table(spark, rows), least=4, longest=longest, share=share, keep=keep, bits=16).collect()
    want = plain_collocations(rows, 4, longest, keep, share)
    assert len(want) > 20 and sorted(map(tuple, got)) == want


def test_collocations_of_nothing(spark):
    assert collocations.collocations(table(spark, []), bits=16).collect() == []
    assert collocations.collocations(table(spark, [(1, None, None), (2, "once only", "en")]), bits=16).collect() == []


def test_slices_of_long_texts_cut_only_between_pieces(monkeypatch):
    import pyarrow as pa

    text = prose(5, 4000)
    batch = pa.record_batch([pa.array([text, "tail a b"]), pa.array(["en", None])], names=["text", "lang"])
    whole = [(w.hash.tolist(), w.next.tolist()) for w, _ in collocations._slices([batch], 0)]
    monkeypatch.setattr(collocations, "SLICE", 500)
    cut = [(w.hash.tolist(), w.next.tolist()) for w, _ in collocations._slices([batch], 0)]
    assert len(cut) > 10 and sum((h for h, _ in cut), []) == sum((h for h, _ in whole), [])
    assert sum((n for _, n in cut), []) == sum((n for _, n in whole), [])


def test_bits_prune_and_never_drop(spark):
    """With bits enough for these words few n-grams are counted that are not frequent; with very few bits many are."""
    rows = [(i, " ".join(random.Random(i).choices([f"w{j}" for j in range(3000)], k=400)) + " twice said" * 2, "en") for i in range(30)]
    texts = table(spark, rows).select("lang", "text")
    first = texts.mapInArrow(collocations._pass(1, 2, 20, 0, None, None), collocations._schema(1)).cache()
    words = first.where("n is not null").groupBy("lang", "word", "h1").sum("n").withColumnRenamed("sum(n)", "n").where("n >= 10")
    marked = collocations._marked(words, 1, 20)
    buckets = collocations._bitmap(first.where("block is not null").select("block", "places", "counts"), 10, 20)
    parts = texts.mapInArrow(collocations._pass(2, 2, 20, 0, marked, buckets), collocations._schema(2)).where("part is not null").repartition(2, "part").sortWithinPartitions("part")
    counted = parts.mapInArrow(collocations._summed(2, 1), "h1 long, h2 long, n long")
    assert 1 <= counted.count() <= 40  # of some 12,000
    assert counted.where("n >= 10").count() == 2
    first.unpersist()


# spelling


def lost(doc, run):
    low = run.translate(LOWER)
    h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
    return low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain_variants(n):
    near = {u: [v for v in n if one_edit(u, v)] for u in n}
    form = {}
    for u, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[u] = best if best is not None and n[best] >= 10 * n[u] else None
    out = []
    for u in n:
        root = u
        while form[root] is not None:
            root = form[root]
        out.append((u, form[u], root, n[u], len(near[u]), n[form[u]] if form[u] else None))
    return sorted(out)


def spelt(seed, n):
    draw, out = random.Random(seed), set()
    while len(out) < n:
        w = "".join(draw.choice("abß") for _ in range(draw.choice([7, 7, 8, 8, 9, 12])))
        out.add(w)
        out.add(w[:3] + draw.choice("abcé") + w[draw.choice([3, 4]) :])
    return sorted(w for w in out if len(w) >= 7)


@pytest.mark.parametrize("block", [2, 48])
def test_variants(spark, block, monkeypatch):
    draw = random.Random(4)
    words = {w: draw.choice([2, 2, 3, 25, 30, 400, 5000]) for w in spelt(1, 500)}
    words |= {"a" * 90: 3, "a" * 91: 40, "a" * 40 + "b" + "a" * 49: 2, "abcdefg" * 30: 2}
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (block, spelling.LETTERS))
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert sorted(map(tuple, got)) == plain_variants(words)


def test_each_pair_comes_once(spark):
    words = spelt(2, 300)
    pairs = spelling.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), block=3).collect()
    got = Counter(tuple(sorted((p.u, p.v))) for p in pairs)
    assert max(got.values()) == 1 and set(got) == {(u, v) for i, u in enumerate(words) for v in words[i + 1 :] if one_edit(u, v)}


def test_runs(spark):
    rows = [(i, "Résumé WRITING writing writings Übersee ünterschied " + " ".join(f"Writingxyz{c}" for c in "abcdefgh") + "é×÷abc_longer", "en") for i in range(150)]
    rows += [(None, "nullable nullable", None), (5, None, "en"), (5, "", "en"), (6, rows[0][1], "en"), (6, rows[0][1], "en")]
    want = Counter()
    for i, t, _ in rows:
        want.update(w for w in (lost(i, x) for x in re.findall(r"[A-Za-zÀ-ÿ]+", t or "")) if len(w) >= 7)
    got = spelling.runs(table(spark, rows)).collect()
    assert {r.word: r.n for r in got} == want and any(len(w) == 7 and "wrting" in w or "writng" in w for w in want)


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).collect() == []


# licenses


def plain_scan(text, templates=licenses.TEMPLATES):
    ws = re.findall(licenses.WORDS, (text or "").translate(LOWER))
    base = [(i, label) for p, label in licenses.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    ready, found = licenses.prepared(templates), []
    for size in {t["size"] for t in ready}:
        for j in range(len(ws) // size + 1):
            block = set(ws[j * size : (j + 2) * size])
            met = {t["id"]: (len(block & set(t["tokens"])) / len(t["tokens"]), len(block & set(t["tokens"])), t) for t in ready if t["size"] == size and len(block & set(t["tokens"])) >= t["need"]}
            found += [(t["label"], s) for s, o, t in met.values() if not any(r in met and met[r][:2] > (s, o) for r in t["rivals"])]
    return len(ws), sorted(base), {label for label, _ in found}, max([1.0] * bool(base) + [s for _, s in found], default=0.0)


def license_texts():
    draw = random.Random(8)
    filler = lambda n: " ".join(draw.choice(["lorem", "the", "of", "software", "or", "Wörter", "under"]) for _ in range(n))
    out = [None, "", " \n", "MIT License", "mit license, mit-license apache license general public\nlicense x", "the license of MIT"]
    for label, text in licenses.TEMPLATES:
        ws = text.split()
        out += [filler(37) + "\n" + text.replace(" ", "\n", 3) + " " + filler(11), " ".join(w for w in ws if draw.random() > 0.12), " ".join(w for w in ws if draw.random() > 0.3), filler(200) + " " + " ".join(sorted(ws)) + filler(3), f"{text} {text.upper()}"]
    return [*out, " ".join(t for _, t in licenses.TEMPLATES) * 3, filler(5000)]


def test_license_scan(spark):
    texts = license_texts()
    rows = licenses.scan(table(spark, list(zip(range(len(texts)), texts, ["en"] * len(texts), strict=True)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, base, labels, _ = plain_scan(texts[r.doc_id])
        assert (r.n_words, sorted((p.start, p.label) for p in r.base)) == (n, base)
        assert {licenses.TEMPLATES[m.id][0] for m in r.found} == labels, texts[r.doc_id]


def test_license_query(spark, tmp_path):
    texts = license_texts()
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "apache license", None), (3, texts[3], "en")]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = licenses.op13_license_scans(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t, _ in rows:
        n, base, own, score = plain_scan(t)
        labels = {label for _, label in base}
        want[(i, n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | own)), score)] += 1
    assert Counter(map(tuple, got)) == want


def test_whole_notices_are_found_and_rivals_settled(spark):
    texts = [t for _, t in licenses.TEMPLATES] + ["Licensed under CC BY-NC 4.0.", "Released under the BSD License."]
    rows = licenses.scan(table(spark, list(zip(range(len(texts)), texts, [None] * len(texts), strict=True)))).collect()
    own = {r.doc_id: {licenses.TEMPLATES[m.id][0] for m in r.found} for r in rows}
    assert all(own[i] == {label} for i, (label, _) in enumerate(licenses.TEMPLATES)) and own[len(texts) - 2] == {"cc-by-nc"} and own[len(texts) - 1] == set()


def test_empty_documents(spark):
    assert licenses.scan(table(spark, [])).collect() == []


def test_license_filters_keep_all_matches():
    """The prefix of a template that has to be searched meets every block that holds enough of its words."""
    for t in licenses.prepared():
        prefix = t["tokens"][: len(t["tokens"]) - t["need"] + 1]
        draw = np.random.default_rng(t["id"])
        for _ in range(50):
            block = set(draw.choice(t["tokens"], t["need"], replace=False).tolist())
            assert block & set(prefix)
