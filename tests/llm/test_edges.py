"""Nulls, empty tables, long texts, ties, repeated rows, clashing columns, for every operator; and brute force where SQL has no say."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import ann, bpe, hpylm, langid, line_dedup, minhash, mixing, pii, token_files, vector_dedup
from jobloom.llm.common import fresh_dir

WORDS = ["alpha", "beta", "gamma", "delta", "über", "naïve", "kappa", "lambda", "omega", "Sigma"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rank string, id string, line string"


def words(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def odd_rows():
    rng = random.Random(3)
    long = words(rng, 6000)
    base = words(rng, 120)
    texts = [None, "", " \n\t", "one", "one two", base, base, base + " tail", long, long + " x", "12 34", "漢字 text", "<|endoftext|>", "a" * 3000, "mail a.b@c.example and +1 (269) 555-3296 4539578763621486"]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s1", "s2"][i % 4], 0, "x", "y", "z", "w") for i, t in enumerate(texts)]
    rows += [rows[5], (None, base, "en", "s2", 0, "", "", "", ""), (3, "other text under an id in use", None, "s1", 0, "", "", "", "")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mix(spark, odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(empty).count() == 0
    again = mixing.mix(odd.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 3}", 0, "", "", "", "") for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    per = got.groupby("source").agg(t=("target", "first"), s=("source_size", "first"), k=("taken", "sum"))
    assert abs(per.t.sum() - 1.5 * per.s.sum()) < 1e-6
    assert (abs(per.k - per.t) <= 3.5).all()
    assert (per.t <= 2 * per.s + 1e-9).all()


def test_mix_unequal_odds(spark):
    """Long texts are wanted more often, as wanted() says, and targets are met as the sizes at hand allow."""
    rng = random.Random(8)
    sizes = [rng.choice((3, 40, 700, 3000)) for _ in range(3000)]
    rows = [(i, "w " * n, "en", f"s{i % 2}", 0, "", "", "", "") for i, n in enumerate(sizes)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    per = got.groupby("source").agg(t=("target", "first"), s=("source_size", "first"), k=("taken", "sum"))
    assert (abs(per.k - per.t) <= 350).all()
    for name, part in got.groupby("source"):
        q = (part["size"] * 1024 // (part["size"] + mixing.HALF)) / 1024
        mean, middle = per.t[name] / per.s[name], (q * part["size"]).sum() / part["size"].sum()
        want = mean + 0.5 * min(mean / middle, (2 - mean) / (1 - middle)) * (q - middle)
        assert want.min() >= 0 and want.max() <= 2
        assert ((part.copies == np.floor(want)) | (part.copies == np.floor(want) + 1)).all()
        for n in (3, 40, 700, 3000):
            assert abs(part.copies[part["size"] == n].mean() - want[part["size"] == n].iloc[0]) < 0.2
    carried = mixing.mix(spark.createDataFrame(rows, SCHEMA), carry=True)
    assert carried.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "copies"]
    assert sorted((r["doc_id"], r["copies"]) for r in carried.collect()) == sorted(zip(got.doc_id, got.copies, strict=True))


def brute_lines(rows, noise, guarantee):
    """Lines that must go: those of repeated runs of at least guarantee words; and the lines that have an earlier equal, which alone may."""
    seen, lines, must, may = {}, {}, {}, {}
    for i, t in rows:
        ls = [x.strip("\t\n\x0b\x0c\r ") for x in (t or "").split("\n")]
        ls = [x for x in ls if x.encode().split()]
        must[i], may[i] = set(), set()
        for a, x in enumerate(ls):
            if x in lines:
                may[i].add(a)
            lines.setdefault(x, i)
            w, b = 0, a
            while b < len(ls) and w < guarantee:
                w += len(ls[b].encode().split())
                b += 1
            if w >= guarantee:
                g = tuple(ls[a:b])
                if g in seen:
                    must[i] |= set(range(a, b))
                seen.setdefault(g, i)
    return must, may


def test_line_dedup_brute(spark):
    rng = random.Random(5)
    pool = [words(rng, rng.randint(1, 12)) for _ in range(60)]
    rows = []
    for i in range(120):
        ls = [words(rng, rng.randint(1, 10)) for _ in range(rng.randint(0, 8))]
        at, n = rng.randrange(50), rng.randint(0, 10)
        ls[len(ls) // 2 : len(ls) // 2] = pool[at : at + n]
        rows.append((i, "\n".join(ls)))
    must, may = brute_lines(rows, 10, 20)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), noise=10, guarantee=20).collect()}
    assert any(must.values())
    for i, t in rows:
        assert len(must[i]) <= got[i]["n_removed"] <= len(may[i])
        kept = got[i]["text"].split("\n")
        assert got[i]["n_lines"] - got[i]["n_removed"] == len(kept) or not got[i]["text"]
        it = iter(t.split("\n"))
        assert all(k in it for k in kept if k)  # in order


def test_line_dedup_odd(spark, odd, empty):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_removed"]
    rows = got.collect()
    assert len(rows) == odd.count()
    assert [r["n_lines"] for r in rows if r["text"] is None] == [0]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_minhash_odd(spark, odd, empty):
    got = minhash.near_duplicates(odd, width=2).collect()
    assert len(got) == odd.count()
    by = {(r["doc_id"], r["n_shingles"]): r for r in got}
    assert by[(0, 0)]["component_id"] == 0 and by[(1, 0)]["kept"]
    assert by[(6, 119)]["component_id"] == 5 if (6, 119) in by else True
    assert all(r["component_id"] <= r["doc_id"] for r in got if r["doc_id"] is not None and r["component_id"] is not None)
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_shared_ids(spark):
    """Texts under one id, or under none, are told apart."""
    rng = random.Random(4)
    t, other = words(rng, 100), words(rng, 100)
    rows = [(3, other), (3, t), (1, t + " one"), (None, other), (None, t), (2**63 - 1, other), (None, words(rng, 60)), (3, t)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()]
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    want = [(3, 3, True), (3, 1, False), (1, 1, True), (None, 3, False), (None, 1, False), (2**63 - 1, 3, False), (None, None, True), (3, 1, False)]
    assert sorted(got, key=key) == sorted(want, key=key)
    left = minhash.deduplicate(docs.withColumn("id", F.lit("clash")).withColumn("tag", F.lit(1)))
    assert left.columns == ["doc_id", "text", "id", "tag"]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted([(1, rows[2][1]), (3, other), (0, rows[6][1])])


@pytest.mark.parametrize("most", [7, 1024])
def test_minhash_far_groups(spark, monkeypatch, most):
    """A large group of edits of one text, similar to some and not to others: components are those of all pairs, however buckets are cut."""
    monkeypatch.setattr(minhash, "BLOCK", most)
    monkeypatch.setattr(minhash, "PAIRS", 500)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(100), rng.randint(1, 9)):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    sets = {i: minhash.shingle_set(t, 2) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    near = [(i, j) for i, a in sets.items() for j, b in sets.items() if i < j and 100 * len(a & b) >= 80 * len(a | b)]
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert 1 < len(set(label.values())) < 150
    assert got == label


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_brute(spark, width):
    rng = random.Random(width)
    base = [words(rng, rng.randint(1, 80)).split() for _ in range(12)]
    rows = []
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    sets = {i: minhash.shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: root(i) for i in sets}
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) for r in got)


def test_bpe(spark, odd, empty):
    from tokenizers import Tokenizer

    path = bpe.vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = odd_rows()
    got = bpe.encode_documents(odd.coalesce(1), path, with_ids=True).collect()
    for r, (i, t, *_) in zip(got, rows, strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert r["doc_id"] == i and np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["decoded"] == lib.decode(ids, skip_special_tokens=False) == (t or "")
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_documents(empty, path).count() == 0


def test_bpe_pieces():
    from tokenizers import Tokenizer

    path = bpe.vocabulary("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bpe.PairIndexBPE(path)
    rng = random.Random(1)
    alphabet = "aab  \n\tthe'sé1 2<|endoftext|>漢字🙂\x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["a" * 50, "aaa" * 7, " " * 9]
    for x, y in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(y, "<u4").tolist() == lib.encode(x, add_special_tokens=False).ids
        assert own.decode(y) == x


def test_elias_fano():
    rng = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 0), (1, 10**12), (700, 3), (3000, 10**9), (5000, 5000)):
        v = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        e = token_files.EliasFano.of(v)
        data, meta = e.dump()
        e = token_files.EliasFano.load(data, meta)
        assert e.slice(0, n).tolist() == v.tolist()
        for k in range(0, n, 97):
            assert e.get(k) == int(v[k]) and e.slice(k, n).tolist() == v[k:].tolist()
        if n > 100:
            assert (len(e.high) + len(e.low)) * 8 <= n * (2 + math.log2(top / n + 1) + 1) + 64


def test_token_files(spark, odd, empty):
    from tokenizers import Tokenizer

    path = bpe.vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    shards = token_files.write_shards(odd, path, fresh_dir(spark, "t"))
    got = sorted(token_files.read_shards(spark, shards).collect(), key=lambda r: r["start"])
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (i, t, *_) in zip(got, rows, strict=True):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.write_shards(empty, path, fresh_dir(spark, "t")) == []
    assert token_files.read_shards(spark, []).count() == 0


def test_language_id(spark, odd, empty):
    rng = random.Random(9)
    say = {"en": "the and of that with for is to", "de": "der die und nicht mit für ist zu", "es": "el la los que con para es por"}
    rows = [(i, " ".join(rng.choice(say[k].split()) for _ in range(rng.randint(5, 60))), k) for i in range(300) for k in [rng.choice(list(say))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = langid.remainder(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held))
    got = langid.identify(docs.where(held), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert sum(r["rejected"] for r in got) <= 0.02 * len(got)
    junk = ["".join(rng.choice("qxzjkvwyq ") for _ in range(n)) for n in (40, 300, 3000)] + ["mikä on tämän talon nimi ja kuka asuu siinä yksin " * 3]
    assert all(r["rejected"] for r in langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(junk)], "doc_id long, text string"), model).collect())
    odd_got = langid.identify(odd, model).collect()
    assert len(odd_got) == odd.count()
    assert all((r["lang_pred"] == "und") == (not r["text"] or not any(map(str.isalpha, r["text"]))) for r in odd_got)
    assert all(0 <= r["score"] <= 1 for r in odd_got)
    none = langid.identify(odd, langid.fit(empty)).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_language_brute(spark):
    """Language and score are those of the nearest centroid by a cosine written out cell by cell."""
    rng = random.Random(12)
    say = {"en": "the and of that with for is to", "de": "der die und nicht mit für ist zu"}
    rows = [(i, " ".join(rng.choice(say[k].split()) for _ in range(rng.randint(3, 30))), k) for i in range(80) for k in [rng.choice(list(say))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, dim=256)
    for r in langid.identify(docs, model).collect():
        cells = [math.log1p(float(n)) * float(w) for n, w in zip(langid.counts(r["text"], 256), model.idf, strict=True)]
        length = math.sqrt(sum(x * x for x in cells))
        near = [sum(x * float(y) for x, y in zip(cells, c, strict=True)) / length for c in model.centroids]
        best = max(range(len(near)), key=lambda k: near[k])
        assert r["lang_pred"] == model.langs[best] and abs(r["score"] - near[best]) < 1e-5 and r["rejected"] == (r["score"] < max(langid.FLOOR, model.least[best] * min(1, sum(x > 0 for x in cells) / langid.FULL)))


def test_language_sample_is_bounded(spark):
    """Rows without ids, equal rows and dirty labels don't swell the sample."""
    rows = [(None, f"the river and the stone {i}", "en") for i in range(400)] + [(3, "der Fluss und der Stein", "de")] * 300 + [(i, "zzz", f"l{i}") for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=40, languages=3)
    assert set(model.langs) >= {"de", "en"} and len(set(model.langs)) == 3


def test_pii_brute():
    import re

    patterns = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def brute(t):
        out = [("email", *m.span()) for m in patterns[0].finditer(t)]
        out += [("ip", *m.span()) for m in patterns[1].finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
        out += [("card", *m.span()) for m in patterns[2].finditer(t) if 14 <= len(pii.digits(m.group())) <= 19 and pii.luhn(pii.digits(m.group()))]
        out += [("phone", *m.span()) for m in patterns[3].finditer(t) if 10 <= len(pii.digits(m.group())) <= 15]
        return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))

    rng = random.Random(8)
    for _ in range(4000):
        t = "".join(rng.choice("a.@+-1 (9)2,5%_\n4é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute(t), t


def test_pii_model_held_out():
    w, rng = pii.train(), random.Random(77)
    hit = miss = extra = 0
    for _ in range(150):
        text, gold = pii.example(rng)
        found = {s for lo, hi in pii.regions(text) for s in pii.viterbi(pii.Region(text, lo, hi), w)}
        hit, miss, extra = hit + len(found & set(gold)), miss + len(set(gold) - found), extra + len(found - set(gold))
    assert hit / (hit + miss) > 0.95 and extra / (hit + extra) < 0.03


def test_pii(spark, odd, empty):
    got = {r["doc_id"]: r for r in pii.find_pii(odd).collect()}
    assert got[0]["spans"] == "" and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (got[14]["n_email"], got[14]["n_phone"], got[14]["n_added"]) == (1, 0, 2)  # phone and card run together for the patterns
    assert pii.find_pii(empty).count() == 0


def test_lm_scores(spark, odd, empty):
    held = langid.remainder(F.col("doc_id"), 5) == 1
    rows = odd_rows()
    got = hpylm.score(odd, held).collect()
    assert len(got) == len(rows)
    count = Counter()
    tokens = [(i, (t or "").encode().lower().split() + [hpylm.END]) for i, t, *_ in rows]
    for i, ws in tokens:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            count.update(ws)
    n, v = sum(count.values()), len(count)
    want = sorted((len(ws), sum(w in count for w in ws), round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for _, ws in tokens)
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] <= 0 for r in got)
    assert hpylm.score(empty, held).count() == 0


def test_lm_sums_to_one():
    rng = np.random.default_rng(2)
    word, context, count = np.array([0, 0, 1, 2, 2, 2]), np.array([0, 1, 1, 0, 1, 2]), np.array([3, 1, 90, 1, 7, 2])
    row = {"owner": 0, "word": word.astype("<u4").tobytes(), "context": context.astype("<u2").tobytes(), "count": count.astype("<u8").tobytes(), "total": np.bincount(word, count).astype("<u8").tobytes()}
    o = hpylm.Owner(row, 0.5, 0.4)
    tables = hpylm.seat(o.count, rng.random(6) * 3, 0.5, rng)
    assert ((tables >= 1) & (tables <= count)).all()
    totals = np.zeros(hpylm.CONTEXTS + 2)
    totals[:3], totals[-1] = np.bincount(context, tables), 3
    customers = np.zeros(hpylm.CONTEXTS + 2)
    customers[:3] = np.bincount(context, count)
    parent = o.parent(tables, totals)
    unseen = (hpylm.STRENGTH + 0.4 * 3) / (hpylm.STRENGTH + tables.sum())
    assert abs(parent.sum() + unseen - 1) < 1e-12
    for u in range(3):
        here = {w: p for w, c, p in zip(word, context, o.predictive(tables, totals, customers), strict=True) if c == u}
        back = (hpylm.STRENGTH + 0.5 * totals[u]) / (hpylm.STRENGTH + customers[u])
        total = sum(here.values()) + back * (sum(parent[w] for w in range(3) if w not in here) + unseen)
        assert abs(total - 1) < 1e-12


def vector_rows():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 16))
    x[200:300] = x[:100] + 0.08 * rng.standard_normal((100, 16))
    x[300:330] = x[0] + 0.05 * rng.standard_normal((30, 16))
    x[330:340] = x[7]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    return rows, x, [(500, None, 1), (600, [], 1), (700, [0.0] * 16, 1), (800, [float("nan")] * 16, 1), (801, [1.0, None], 1), (900, [1.0, 2.0], 1), (None, x[3].tolist(), 1), rows[5]]


def test_near_vectors(spark):
    rows, x, odd = vector_rows()
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")).toPandas().set_index("vec_id")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.95
    label = np.arange(len(x))
    while True:
        new = np.array([label[row].min() for row in link])
        if (new == label).all():
            break
        label = new
    assert got.n_links.sort_index().tolist() == (link.sum(axis=1) - 1).tolist()
    assert got.component_id.sort_index().tolist() == label.tolist()
    more = vector_dedup.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, id int")).collect()
    assert len(more) == len(rows) + len(odd)
    assert all(r["n_links"] == 0 and r["kept"] for r in more if r["vec_id"] in (500, 600, 700, 800, 801, 900))
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("region, split, fine", [(37, 41, 4), (1 << 16, 100, 8), (90, 1 << 16, 512)])
def test_near_vectors_split(spark, monkeypatch, region, split, fine):
    """However regions are cut, coarse or fine, every link counts once."""
    for name, value in (("REGION", region), ("SPLIT", split), ("FINE", fine), ("PAIRS", 300)):
        monkeypatch.setattr(vector_dedup, name, value)
    rows, x, _ = vector_rows()
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")).toPandas().sort_values("vec_id")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert got.n_links.tolist() == ((u @ u.T >= 0.95).sum(axis=1) - 1).tolist()


def test_near_vectors_shared_ids(spark):
    """Different vectors under one id, or under none, have their own links."""
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    near = lambda v: [c + 0.1 * (k == 2) for k, c in enumerate(v)]
    rows = [(5, a), (5, b), (7, near(a)), (8, near(b)), (2**63 - 1, [0.0, 0.0, 0.0, 1.0]), (None, [0.0, 0.0, 0.1, 1.0]), (None, [0.0, 0.0, -1.0, 0.0])]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("own", F.lit(1))).collect()
    want = [(5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (8, 1, 5, False), (2**63 - 1, 1, 2**63 - 1, True), (None, 1, 2**63 - 1, False), (None, 0, None, True)]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_nearest(spark):
    rows, x, odd = vector_rows()
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, id int")
    got = ann.search(frame, F.col("vec_id") % 100 == 0).collect()
    hits = total = 0
    for q in range(0, 400, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = set(np.argsort(d, kind="stable")[:10].tolist())
        mine = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in sorted(mine, key=lambda r: r["rank"])] == list(range(1, 11))
        assert all(r["vec_id"] is None or r["vec_id"] > 399 or abs(r["score"] - d[r["vec_id"]]) < 1e-12 for r in mine)
        hits, total = hits + len(want & {r["vec_id"] for r in mine}), total + 10
    assert hits / total >= 0.9
    tiny = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>, id int")
    assert len(ann.search(tiny, F.col("vec_id") == 0).collect()) == 3
    assert ann.search(tiny.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("dealt, inner", [(1, 1), (2, 1), (1, 0), (1, 2)])
def test_nearest_layouts(spark, monkeypatch, dealt, inner):
    """Whatever axes vectors are dealt by and however groups are cut, all probed buckets are measured: with all of them the answer is exact."""
    monkeypatch.setattr(ann, "BLOCK", 9)
    rows, x, _ = vector_rows()
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int"), F.col("vec_id") % 200 == 0, tables=1, probes=1 << 15, dealt=dealt, inner=inner).collect()
    for q in (0, 200):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == np.lexsort((np.arange(len(x)), d))[:10].tolist()


@pytest.mark.parametrize("most", [12, 60, 10**6])
def test_components(spark, monkeypatch, most):
    from jobloom.llm import components

    monkeypatch.setattr(components, "LINKS_PER_TASK", most)
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(1000, 1040)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(7, 7)]
    parent = {n: n for p in links if p[0] != p[1] for n in p}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup_tails(spark):
    """Maximal repeated runs go whole: long lines before a short tail that the first copy of the long lines lacks."""
    p1, p2, s1, s2 = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("p", 55), ("q", 60), ("r", 35), ("s", 35)))
    texts = ["\n".join(x) for x in ([p1, p2, s1], [p1, p2, s2], [p1, p2, s2])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: texts[0], 1: s2, 2: ""}

    rng, noise, guarantee = random.Random(11), 10, 20
    pool = [words(rng, rng.choice((2, 6, 12, 22, 30))) for _ in range(12)]
    docs = [[rng.choice(pool) for _ in range(rng.randrange(1, 7))] for _ in range(80)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame([(i, "\n".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"), noise=noise, guarantee=guarantee).collect()}
    earlier: set[tuple] = set()
    for i, d in enumerate(docs):
        gone, size = set(), [len(x.split()) for x in d]
        for a in range(len(d)):
            for b in range(a, len(d)):
                run = tuple(d[a : b + 1])
                if sum(size[a : b + 1]) >= guarantee:
                    if run in earlier:
                        gone |= set(range(a, b + 1))
                    earlier.add(run)
        assert not Counter(got[i]["text"].split("\n")) - Counter(x for j, x in enumerate(d) if j not in gone) - Counter([""]), i


def test_lm_contexts_are_words(spark):
    """Words before that end alike are contexts of their own: which word follows which one shows in the score."""
    pairs = [("the", "xx"), ("bathe", "yy")]
    rows = [(i, " ".join(pairs[i % 2]), False) for i in range(200)] + [(1000, "the xx", True), (1001, "bathe yy", True), (1002, "the yy", True), (1003, "bathe xx", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    got = {r["doc_id"]: r["score"] for r in hpylm.score(docs, F.col("held")).collect()}
    assert len(got) == 204 and min(got[1000], got[1001]) > max(got[1002], got[1003]) + 1


def test_lm_scores_brute(spark):
    """Where no pair of words comes twice each has one table: scores are those of the formula, with T_u and N_u of the whole corpus."""
    texts = [f"s{i} w{i % 7} w{i // 7 + 7} w{i % 7 + 20 + i // 7 * 7} e{i}" for i in range(42)]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(100, "s1 w3 w9 new w3", True)]
    got = {r["doc_id"]: r["score"] for r in hpylm.score(spark.createDataFrame(rows, "doc_id long, text string, held boolean"), F.col("held")).collect()}
    split = lambda t: [hpylm.START, *t.encode().split(), hpylm.END]
    pairs = Counter(p for t in texts for p in zip(split(t), split(t)[1:]))
    assert set(pairs.values()) == {1}
    d, s = 0.95, hpylm.STRENGTH  # no pair of two
    after, tables = Counter(u for u, _ in pairs), Counter(w for _, w in pairs)
    kinds = Counter(tables.values())
    d0, n0, v = hpylm._discount(kinds[1], kinds[2]), len(pairs), len(tables)
    for i, t, _ in rows:
        want = 0.0
        for u, w in zip(split(t), split(t)[1:]):
            p = (tables[w] - d0 if tables[w] else s + d0 * v) / (s + n0)
            c = pairs[u, w]
            want += math.log10((c - d * c + (s + d * after[u]) * p) / (s + after[u]))
        assert abs(got[i] - want) < 1e-6, i


def test_lm_seats_exact():
    """Gaps drawn at once give as many tables as customers seated one by one, with large weights of a new table too."""
    rng, d = np.random.default_rng(4), 0.8
    for n, a in ((1000, 100.0), (3000, 1000.0), (1000, 2.0)):
        slow = np.ones(200)
        for j in range(1, n):
            slow += rng.random(200) * (j - d * slow + a) < a
        fast = hpylm.seat(np.full(200, n), np.full(200, a), d, rng)
        assert abs(fast.mean() - slow.mean()) < 0.02 * slow.mean() + 0.5, (n, a)
