"""Language identification, near-duplicates, embeddings and the language model against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexicask.llm import embeddings, langid, maxent, neardup
from lexicask.llm.components import components

WORDS = [f"{a}{b}{c}" for a in ("ba", "co", "di", "fu", "ge") for b in ("lan", "mer", "nos", "pit") for c in ("a", "en", "is", "or", "ul")]


def union_find(links, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


# -- components


def test_components(spark, tmp_path):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(200, 400)] + [(rng.randint(1000, 1300), rng.randint(1000, 1300)) for _ in range(200)] + [(7, 7), (5000, 5001), (5001, 5000)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in components(df, f"file://{tmp_path}").collect()}
    nodes = {x for l in links if l[0] != l[1] for x in l}
    assert got == union_find([l for l in links if l[0] != l[1]], nodes)
    assert components(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_few_links_take_few_jobs(spark, tmp_path, monkeypatch):
    """Up to MOST links are joined by one task, whatever the shuffle partitions; more go through the rounds, with the same result."""
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(300)] + [(rng.randint(1000, 3000), rng.randint(1000, 3000)) for _ in range(900)] + [(-5, 300), (9, 9)]
    spark.createDataFrame(links, "a long, b long").write.parquet(f"{tmp_path}/in")
    df, context = spark.read.parquet(f"{tmp_path}/in"), spark.sparkContext
    context.setJobGroup(f"{tmp_path}", "components")
    few = components(df, f"file://{tmp_path}/few")
    jobs = len(context.statusTracker().getJobIdsForGroup(f"{tmp_path}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    got = {r.id: r.component for r in few.collect()}
    assert 0 < jobs <= 4
    assert got == union_find([l for l in links if l[0] != l[1]], {x for l in links if l[0] != l[1] for x in l})
    monkeypatch.setattr("lexicask.llm.components.MOST", len(links) - 1)
    assert got == {r.id: r.component for r in components(df, f"file://{tmp_path}/many").collect()}


# -- near-duplicate texts


def brute_classes(texts):
    ids = list(texts)
    cells = sum(neardup.word_cells(pa.array([texts[i]])) for i in ids)
    idf = neardup.idf_table(len(ids), cells)
    sets = {}
    for i in ids:
        value, weight, _, _, _ = neardup.shingles(pa.array([texts[i]]), idf)
        sets[i] = dict(zip(value.tolist(), weight.tolist()))
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                least = sum(min(w, sets[b][s]) for s, w in sets[a].items() if s in sets[b])
                if least / (sum(sets[a].values()) + sum(sets[b].values()) - least) >= neardup.SIMILAR:
                    links.append((a, b))
    return union_find(links, ids)


def test_shingle_weights():
    column = pa.array(["a b c d e f", "A  b\tc d e f", "a b", None, " \n", "x x x x x x x"])
    idf = neardup.idf_table(6, sum(neardup.word_cells(column.slice(k, 1)) for k in range(6)))
    value, weight, count, h1, h2 = neardup.shingles(column, idf)
    assert count.tolist() == [2, 2, 1, 0, 0, 1]
    assert (value[:2] == value[2:4]).all() and h1[0] == h1[1] != h1[2] and h1[3] == h2[4] == 0
    assert weight[-1] == pytest.approx(3 * math.log1p(6 / 1), rel=1e-6)


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    found = []
    for k in range(60):
        value = np.unique(rng.integers(0, 2**63, 120).astype(np.uint64))
        wa, wb = rng.uniform(0.5, 6, len(value)), rng.uniform(0.5, 6, len(value))
        wb = np.where(rng.random(len(value)) < 0.7, wa, wb)
        s = neardup.samples(np.tile(value, 2), np.concatenate([wa, wb]), np.array([len(value)] * 2))
        found.append((np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), (s[0] == s[1]).mean()))
    true, est = np.array(found).T
    assert abs((est - true).mean()) < 0.03


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", 3)  # so that larger buckets are split
    rng = random.Random(4)
    text = lambda n: [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    texts, n = {}, 0
    for size in (1, 2, 5, 30):
        for _ in range(4):
            base = text(rng.randint(60, 150))
            for k in range(size):
                own = list(base)
                for _ in range(rng.randint(0, 2) if k else 0):
                    own[rng.randrange(len(own))] = rng.choice(WORDS)
                texts[n] = " ".join(own)
                n += 1
    shared = text(60)
    for _ in range(20):  # one long passage in otherwise different texts
        texts[n] = " ".join(text(80) + shared + text(80))
        n += 1
    for extra in ("same short", "same  SHORT", "other short", "", "", " \t"):
        texts[n] = extra
        n += 1
    ids = list(texts)
    rng.shuffle(ids)
    rows = [(i, texts[i], "u") for i in ids] + [(n, None, "u"), (None, "same short", "u"), (0, texts[0], "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(5)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    truth = brute_classes(texts)
    assert got == {i: c for i, c in truth.items() if texts[i].strip()}
    kept = neardup.stage(df)
    assert kept.columns == df.columns
    left = sorted(str(r.doc_id) for r in kept.collect())
    assert left == sorted([str(i) for i, c in truth.items() if i == c] + [str(n), "None", "0"])
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_pairs_in_a_crowd_that_shares_a_passage(spark):
    """Hundreds of texts share a long passage and lie below the limit to each other; planted pairs lie just over it."""
    rng = random.Random(9)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(n)]
    shared, n = text(500), 500
    texts = {k: [*text(10), *shared, *text(10)] for k in range(n)}
    for k in range(n, 2 * n):  # a copy of k - n with two other words
        texts[k] = list(texts[k - n])
        texts[k][4], texts[k][7] = text(2)
    column = pa.array([" ".join(texts[k]) for k in range(2 * n)])
    idf = neardup.idf_table(2 * n, neardup.word_cells(column))
    value, weight, count, _, _ = neardup.shingles(column, idf)
    stop = np.cumsum(count)
    sets = [dict(zip(value[s - c : s].tolist(), weight[s - c : s].tolist())) for s, c in zip(stop.tolist(), count.tolist())]
    similarity = lambda a, b: (x := sum(w for s, w in sets[a].items() if s in sets[b])) / (sum(sets[a].values()) + sum(sets[b].values()) - x)
    assert all(0.8 <= similarity(k, k + n) < 0.84 for k in range(n)) and all(0.5 < similarity(k, k + 1) < 0.7 for k in range(n - 1))
    df = spark.createDataFrame(list(enumerate(column.to_pylist())), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert sum(got[k] != k % n for k in range(2 * n)) == 0


# -- embeddings


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)  # so that crowded buckets are dealt in blocks
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for label in (0, 1, None):
        for size in (1, 1, 1, 3, 60):
            d = 9 if label == 1 and size == 3 or label == 0 and size == 60 and k % 2 else 24
            centre = rng.standard_normal(d)
            for _ in range(size):
                v = centre + rng.standard_normal(d) * 0.12
                rows.append((k, v.astype(np.float32).tolist(), label))
                k += 1
        rows += [(k, rows[-1][1], label), (k + 1, [2 * x for x in rows[-1][1]], label)]
        k += 2
    for d in (2, 5):  # lengths that few vectors have
        centre = rng.standard_normal(d)
        rows += [(k + i, (centre + rng.standard_normal(d) * 0.02).astype(np.float32).tolist(), 1) for i in range(20)]
        k += 20
    hard = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0]]
    rows += [(k + i, v, 0) for i, v in enumerate(hard)]
    df = spark.createDataFrame([(*r, "u") for r in rows], "vec_id long, embedding array<float>, label int, n_links string").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    links, n = [], Counter()
    sound = [(i, np.array(v, float), l) for i, v, l in rows[: -len(hard)] if l is not None]
    for x, (i, v, l) in enumerate(sound):
        for j, w, m in sound[x + 1 :]:
            if l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    assert len(links) > 300
    comp = union_find(links, [r[0] for r in rows])
    found = sum(x for x, _, _ in got.values())
    assert all(got[i][0] <= n[i] for i in comp) and found >= 0.99 * 2 * len(links)
    assert {i: (c, i == c) for i, c in comp.items()} == {i: (c, kept) for i, (_, c, kept) in got.items()}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_codes_are_balanced_and_close():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((4000, 64)) @ rng.standard_normal((64, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    mean, projection = embeddings.fit(v[:2000])
    bits = np.unpackbits(embeddings.codes(v, mean, projection), axis=1)
    assert (abs(bits.mean(axis=0) - 0.5) < 0.1).all()
    near = v + rng.standard_normal(v.shape) * 0.02
    far = (bits != np.unpackbits(embeddings.codes(near / np.linalg.norm(near, axis=1, keepdims=True), mean, projection), axis=1)).sum(axis=1)
    assert far.mean() < 12 < 25 < (bits[1:] != bits[:-1]).sum(axis=1).mean()


# -- language identification


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"kept": F.lit(5), "_host": F.lit(6), "language": F.lit("z")})
    hidden = docs.withColumn("said", F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit("-XX"))))
    got = langid.identify(langid.evidence(hidden, "said", None, "source"), ["doc_id", "lang"]).filter("doc_id % 2 = 1").collect()
    assert sum(r.language == r.lang for r in got) >= 0.98 * len(got) and sum(r.kept for r in got) >= 0.98 * len(got)
    staged = langid.stage(docs)
    assert staged.dtypes == docs.dtypes and {tuple(r) for r in staged.select("kept", "_host", "language").collect()} == {(5, 6, "z")}
    assert langid.stage(docs, wanted=("de",)).count() == pytest.approx(docs.filter("lang = 'de'").count(), abs=3)
    assert langid.stage(docs.limit(0)).count() == 0


def test_hosts_and_declarations_decide_without_text(spark):
    rows = [(k, f"{'the cat and the dog ' if k % 2 else 'der hund und die katze '}{k}" * 3, "en" if k % 2 else "de", "h-en.uk" if k % 2 else "h-de.at", "uk" if k % 2 else "at") for k in range(200)]
    hard = [(900, None, None, "h-de.at", "at"), (901, "", "en", None, None), (902, None, None, None, "uk"), (903, "1", "??", "new.at", "at"), (904, None, None, None, None), (900, None, None, "h-de.at", "at")]
    df = spark.createDataFrame(rows + hard, "id long, text string, lang string, host string, suffix string")
    got = {r.id: r for r in langid.identify(langid.evidence(df, "lang", "suffix", "host"), ["id"]).collect()}
    assert [got[k].language for k in (900, 901, 902, 903)] == ["de", "en", "en", "de"]
    assert got[904].confidence < 0.6 and got[904].language in ("und", "en", "de") and all(got[k].language == ("en" if k % 2 else "de") for k in range(200))
    none = langid.identify(langid.evidence(df.withColumn("lang", F.lit(None).cast("string")), "lang", "suffix", "host"), ["id"])
    assert {(r.language, r.kept) for r in none.collect()} == {("und", True)}


def test_posterior_against_brute_force(spark):
    """Likelihoods, trust, smoothed shares and the row's own part taken out, all by plain counting."""
    rng = random.Random(8)
    said = {"en": "the cat and dog ran to house".split(), "de": "der hund und katze lief zum haus".split(), "fr": "le chat et chien courut vers maison".split()}
    rows = []
    for k in range(90):
        lang = ("en", "de", "fr")[k % 3]
        declared = None if k % 5 == 0 else rng.choice(["en", "de"]) if k % 7 == 0 else lang
        text = None if k % 11 == 0 else " ".join(rng.choice(said[lang]) for _ in range(rng.randint(0, 3)))
        rows.append((k, text, declared, rng.choice([None, f"h{k % 4}"]), rng.choice([None, "at", "uk"])))
    rows += [(100, "x" * 5000, "en", "h1", "at"), rows[1], rows[1]]
    df = spark.createDataFrame(rows, "id long, text string, lang string, host string, suffix string")
    found = langid.evidence(df, "lang", "suffix", "host")
    backwards = spark.createDataFrame(rows[::-1], df.schema).coalesce(1)
    names, model = langid.fit(found.rows)
    again = langid.fit(langid.evidence(backwards, "lang", "suffix", "host").rows)
    assert names == again[0] == ["de", "en", "fr", "und"] and np.allclose(model, again[1])

    def grams(text):
        data = (text or "").lower().encode() + b" "
        return [((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 % 2**32) >> 17 for i in range(len(data) - 2)]

    tables = {n: Counter() for n in names}
    for _, text, declared, _, _ in rows:
        if declared:
            tables[declared].update(grams(text))
    plain = Counter(b for _, text, declared, _, _ in rows if declared for b in (text or "").encode())
    share = lambda b: (plain[b] + 1 + (plain[b - 32] + 1 if 97 <= b <= 122 else 0)) / (sum(plain.values()) + 256)
    used = [b for b in range(256) if not 65 <= b <= 90]
    # probability of one feature under independent bytes: the last byte's part is summed by a table
    def independent(f):
        return sum(share(a) * share(b) * share(c) for a, b, c in by_feature[f])

    wanted = {f for _, text, *_ in rows for f in grams(text)}
    by_feature = {f: [] for f in wanted}
    for a in used:
        for b in used:
            base = (a << 16 | b << 8) * 2654435761
            for c in used:
                f = ((base + c * 2654435761) % 2**32) >> 17
                if f in by_feature:
                    by_feature[f].append((a, b, c))

    def likelihood(text):
        g = grams(text)
        ll = [sum(math.log((tables[n][f] + 2**14 * math.exp(logs[f])) / (sum(tables[n].values()) + 2**14)) if n != "und" else logs[f] for f in g) for n in names]
        scale = min(len(g), 64) / max(len(g), 1)
        return [x * scale for x in ll], len(g) > 0

    logs = {f: math.log(independent(f)) for f in wanted}
    heard = {r[0:2]: likelihood(r[1]) for r in rows}
    top = lambda r: int(np.argmax(heard[r[0:2]][0])) if heard[r[0:2]][1] else None
    at = lambda r: (r[3], r[4] or "")
    got = {r.id: r for r in langid.identify(found, ["id"]).collect()}
    for k, r in enumerate(rows):
        others = [(x, top(x)) for j, x in enumerate(rows) if j != k and top(x) is not None]
        share_of = lambda some, parent: [(sum(s == i for _, s in some) + 20 * p) / (len(some) + 20) for i, p in enumerate(parent)]
        prior = [(sum(s == i for _, s in others) + 1) / (len(others) + 4) for i in range(4)]
        if r[4] and any(x[4] == r[4] and top(x) is not None for x in rows):
            prior = share_of([o for o in others if o[0][4] == r[4]], prior)
        if r[3] and any(at(x) == at(r) and top(x) is not None for x in rows):
            prior = share_of([o for o in others if at(o[0]) == at(r)], prior)
        score = [math.log(p) + x for p, x in zip(prior, heard[r[0:2]][0])]
        if r[2]:
            score = [x + math.log((sum(s == i and o[2] == r[2] for o, s in others) + 0.5) / (sum(s == i and o[2] is not None for o, s in others) + 2)) for i, x in enumerate(score)]
        p = np.exp(np.array(score) - max(score))
        p /= p.sum()
        assert got[r[0]].confidence == pytest.approx(p.max(), abs=2e-3), r
        if p.max() > 0.51:
            assert got[r[0]].language == names[int(p.argmax())]


def test_a_hundred_languages(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    tags = sorted({a + b for a in "abcdefghij" for b in "klmnopqrst"})
    rows = []
    for tag in tags:
        own = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(12)]
        rows += [(len(rows) + k, " ".join(rng.choice(own) for _ in range(40)), tag) for k in range(5)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.language for r in langid.of_documents(df, ["doc_id"]).collect()}
    assert len(tags) == 100 and got == {k: tag for k, _, tag in rows}


def test_texts_of_no_known_language_go(spark, sf):
    rng = random.Random(7)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = "hyvää päivää kaikille ystäville tänään kaunis ilma menemme yhdessä metsään kävelemään koska aurinko paistaa lämpimästi".split()
    odd = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600)), " ".join(rng.choices(words, k=80)), " ".join(str(rng.randint(0, 10**6)) for _ in range(80)), "今天天气很好我们一起去公园散步吧" * 20]
    whole = " ".join(r.text for r in docs.filter("lang = 'en'").limit(40).collect())
    more = spark.createDataFrame([(10**6 + k, t, None, "srcx", len(t)) for k, t in enumerate([*odd, whole])], docs.schema)
    kept = {r.doc_id for r in langid.stage(docs.unionAll(more)).collect()}
    clean = {r.doc_id for r in docs.collect() if len(r.text.split()) >= 50}
    assert clean <= kept and {d for d in kept if d >= 10**6} == {10**6 + len(odd)}


def test_hostile_pages_are_read_once(spark):
    import time

    pages = [("<a " * 300_000), ("<script>" * 100_000) + ">", "<!--" * 200_000 + ">", "<html lang" * 100_000 + ">", None]
    df = spark.createDataFrame([(k, "http://x.example/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    began = time.time()
    assert langid.of_pages(df).count() == len(pages) and time.time() - began < 60


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    marked = pages.select("page_id", F.regexp_extract("html", r'<html lang="(\w+)"', 1).alias("lang"))
    got = langid.of_pages(pages).join(marked, "page_id").filter("lang <> ''").collect()
    assert got and sum(r.language == r.lang for r in got) >= 0.9 * len(got)


# -- language model


def test_language_model(spark):
    rng = random.Random(5)
    follow = {w: rng.choices(WORDS, k=2) for w in WORDS}
    texts = []
    for k in range(300):
        w = [rng.choice(WORDS)]
        while len(w) < 120:
            w.append(rng.choice(follow[w[-1]]))
        texts.append(" ".join(x.upper() if k % 5 == 0 else x for x in w))
    texts += [None, "", "neverseen", " \t\n", texts[0]]
    rows = [*enumerate(texts), (None, "ba"), (3, texts[3])]
    df = spark.createDataFrame([(*r, "u") for r in rows], "doc_id long, text string, score string").repartition(3)
    got = maxent.scores(df, most=20_000).collect()
    assert maxent.chunks(df, 20_000).count() > 6  # in three partitions
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not held(d) for w in token(t))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    texts_of = dict(rows)
    for r in got:
        words = token(texts_of[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
    out = [r for r in got if r.held_out and r.n_tokens > 50]
    # each word has two successors among a hundred: the model must see a good part of that on texts it has not learnt
    assert out and sum(r.score for r in out) > 0.85 * sum(r.base_score for r in out)
    assert maxent.scores(df.limit(0)).count() == 0


def test_score_against_brute_force(spark, monkeypatch):
    """Every text's score again, from the trained weights, word by word with plain Python numbers."""
    kept = []
    train = maxent.train
    monkeypatch.setattr(maxent, "train", lambda *given: kept.append(train(*given)) or kept[0])
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice(["Alpha", "beta", "béta", "x", "gamma-long-word", "alpine"]) for _ in range(rng.randint(0, 12)))) for k in range(60)] + [(60, "unseen Alphb"), (61, None), (61, "x " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {}
    for r in maxent.scores(df, most=300).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    (weights,) = kept
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
    m64 = (1 << 64) - 1

    def mix(h):
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD & m64
        h ^= h >> 33
        h = h * 0xC4CEB9FE1A85EC53 & m64
        return h ^ h >> 33

    step = 0x9E3779B97F4A7C15

    def hashed(w):
        if w is None:
            return int(maxent.END)
        b = w.encode()
        total = sum(mix((int.from_bytes(b[8 * i : 8 * i + 8], "little") + (i + 1) * step) & m64) for i in range((len(b) + 7) // 8))
        h = mix((total + len(b)) & m64)
        klass = mix((int.from_bytes(b[:2], "little") + step) & m64) >> 59
        sub = mix((int.from_bytes(b[:4], "little") * step + step) & m64) >> 59
        return h >> 10 << 10 | klass << 5 | sub

    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(hashed(w) for d, t in rows if not held(d) for w in [*words(t), None])
    tokens, kinds = Counter(), Counter()
    for h, n in counts.items():
        tokens[h & 1023] += n
        kinds[h & 1023] += 1

    def log_softmax(table, at, bias):
        z = [sum(float(table[r][c]) for r in at) + float(bias[c]) for c in range(32)]
        top = max(z)
        return [x - top - math.log(sum(math.exp(y - top) for y in z)) for x in z]

    want = {}
    for d, t in rows:
        one = two = int(maxent.END)
        score = 0.0
        for w in [*words(t), None]:
            h = hashed(w)
            klass, sub = h >> 5 & 31, h & 31
            features = [mix((one + step) & m64), mix(two ^ step), mix((one * 31 + two) & m64)]
            score += log_softmax(weights.first, [f & maxent.FEATURES - 1 for f in features], weights.bias1)[klass]
            own = [((f ^ klass * 0xA24BAED4963EE407 & m64) * step & m64) >> 40 & maxent.FEATURES - 1 for f in features]
            score += log_softmax(weights.second, own, weights.bias2[klass])[sub]
            score += math.log((counts[h] + 1) / (tokens[h & 1023] + kinds[h & 1023] + 1))
            one, two = h, one
        want.setdefault(d, []).append(score / math.log(10))
    assert weights.first.any() and weights.second.any() and got.keys() == want.keys()
    for d in want:
        assert sorted(got[d]) == pytest.approx(sorted(want[d]), rel=1e-4), d


def test_held_out_gain(spark):
    """On texts that were not learnt from, the model beats the unigram shares clearly."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    share = maxent.scores(docs).filter("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert share[0] > 0.97 * share[1]


def test_every_training_position_is_learnt(spark):
    df = spark.createDataFrame([(k, f"w{k} x{k} y{k} z{k} " * 20) for k in range(40)], "doc_id long, text string").coalesce(1)
    (row,) = maxent.chunks(df).collect()
    weights = maxent.Weights(np.ones(maxent.BUCKETS))
    learnt = sum(maxent._learn(row, weights, turn)[2] for turn in range(maxent.ROUNDS))
    assert learnt == sum(n for n, held in zip(row["lengths"], row["held"]) if not held) > 0


def plain_learn(row, weights, turn):
    """maxent._learn, with all slopes added up row by row."""
    words, _, bucket, start = maxent._tokens(row)
    features = maxent._features(words, start)
    train = np.repeat(~np.array(row["held"], bool), row["lengths"])
    at = np.flatnonzero(train & (np.arange(len(words)) % maxent.TURNS == turn % maxent.TURNS))
    np.random.default_rng(turn).shuffle(at)
    tables, squares = [weights.first.copy(), weights.second.copy()], weights.squares.copy()
    for a in range(0, len(at), maxent.STEP_SIZE):
        some = at[a : a + maxent.STEP_SIZE]
        klass, sub = bucket[some] // maxent.CLASSES, bucket[some] % maxent.CLASSES
        for table, square, rows, bias, right in zip(tables, squares, maxent._rows(features, some, klass), (weights.bias1, weights.bias2[klass]), (klass, sub)):
            z = table[rows[0]]
            z += table[rows[1]]
            z += table[rows[2]]
            z += bias
            z -= z.max(axis=1, keepdims=True)
            z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
            slope = np.exp(z)
            slope[np.arange(len(some)), right] -= 1
            every = np.concatenate(rows)
            order = np.argsort(every.astype(np.uint16), kind="stable")
            every = every[order]
            first = np.flatnonzero(np.diff(every, prepend=-1))
            which = every[first]
            slopes = np.add.reduceat(slope.take(order % len(some), axis=0), first, axis=0)
            square[which] += np.einsum("ij,ij->i", slopes, slopes) / maxent.CLASSES
            table[which] -= slopes * (maxent.RATE / np.sqrt(square[which]))[:, None]
    return np.stack([tables[0] - weights.first, tables[1] - weights.second]), squares - weights.squares, len(at)


def test_learning_against_plain_steps(monkeypatch):
    """The same changes as plain steps give; only slopes of rows that a step meets more than once are added up, others are taken as they are."""
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    places = np.minimum(rng.zipf(1.3, 24_000) - 1, len(words) - 1).astype(np.uint32)
    row = {"hashes": words.tobytes(), "tokens": places.tobytes(), "lengths": [300] * 80, "held": [k % 7 == 2 for k in range(80)]}
    weights = maxent.Weights(np.bincount(maxent.buckets_of(words)[places], minlength=maxent.BUCKETS).astype(np.int64))
    their_change, their_squares, their_n = plain_learn(row, weights, 1)
    added = []

    class Add:
        def reduceat(self, x, at, **more):
            added.append((len(x), len(at)))
            return np.add.reduceat(x, at, **more)

    class Numpy:
        add = Add()

        def __getattr__(self, name):
            return getattr(np, name)

    monkeypatch.setattr(maxent, "np", Numpy())
    change, squares, n = maxent._learn(row, weights, 1)
    assert n == their_n and np.abs(change - their_change).max() < 1e-3 and np.allclose(squares, their_squares, rtol=1e-3, atol=1e-3)
    assert added and all(rows >= 2 * sums for rows, sums in added) and sum(rows for rows, _ in added) < 0.8 * 6 * n


def test_probabilities_sum_to_one():
    """Over the seen words and one unseen word of every subclass, after any history."""
    words = np.unique(np.random.default_rng(3).integers(0, 2**63, 5000).astype(np.uint64))
    counts = np.arange(len(words)) % 9 + 1
    bucket = maxent.buckets_of(words)
    tokens, kinds = np.bincount(bucket, weights=counts, minlength=maxent.BUCKETS), np.bincount(bucket, minlength=maxent.BUCKETS)
    weights = maxent.Weights(tokens)
    rng = np.random.default_rng(4)
    weights.first[:], weights.second[:] = rng.normal(size=weights.first.shape), rng.normal(size=weights.second.shape)
    features = maxent._features(words[:3], np.array([True, False, False]))
    at = np.array([2])
    total = 0.0
    z1 = maxent._softmax(weights.first, maxent._rows(features, at, np.array([0]))[0], weights.bias1)[0]
    for klass in range(maxent.CLASSES):
        z2 = maxent._softmax(weights.second, maxent._rows(features, at, np.array([klass]))[1], weights.bias2[[klass]])[0]
        for sub in range(maxent.CLASSES):
            b = klass * maxent.CLASSES + sub
            inside = ((counts[bucket == b] + 1).sum() + 1) / (tokens[b] + kinds[b] + 1)
            total += math.exp(z1[klass] + z2[sub]) * inside
    assert total == pytest.approx(1, abs=1e-4)
