"""Similar names, same postings and groups of copies, against all pairs taken one by one."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from jobloom.operators import groups as G
from jobloom.operators import similar as N
from jobloom.operators.store import cut

POSTINGS = "job_id string, source string, company string, title string, city_region string, country string"


def grouped(spark, rows):
    return {r["job_id"]: r["duplicate_group"] for r in G.duplicate_groups(spark.createDataFrame(rows, POSTINGS)).collect()}


def alike(later, earlier, company=0.92, title=0.93):
    """Whether two profiles (company, title, places, blank) are the same job."""
    near = lambda x, y, least: x == y or SequenceMatcher(None, x, y).ratio() >= least
    named = all((later[0], later[1], earlier[0], earlier[1])) and near(later[0], earlier[0], company) and near(later[1], earlier[1], title)
    if not named:
        return False
    if later[2] and earlier[2]:
        return bool(set(later[2]) & set(earlier[2]))
    return not (later[3] and earlier[2] or earlier[3] and later[2])


def one_by_one(spark, rows):
    found = [r.asDict() for r in N.profiles(spark.createDataFrame(rows, POSTINGS)).collect()]
    profile = lambda r: (r["company"], r["title"], tuple(r["places"]), r["blank"])
    homes, of = [], {}
    for r in sorted(found, key=lambda r: r["job_id"]):
        home = next((h for h in homes if all(alike(profile(r), profile(m)) for m in h)), None)
        if home is None:
            homes.append(home := [])
        home.append(r)
    for h in homes:
        of |= {m["job_id"]: h[0]["job_id"] if len(h) > 1 else "" for m in h}
    return of


def test_duplicate_groups(spark):
    got = grouped(spark, [
        ("a1", "s", "Acme Inc", "Data Analyst", "Paris", "France"), ("a2", "t", "Acme", "Data Analyst (Remote)", "Paris, IdF", "France"), ("a3", "t", "Acme", "Data Analyst", "Berlin", "Germany"),
        ("b1", "s", "Northwind Laboratories", "Risk Analyst", "", ""), ("b2", "t", "Northwind Laboratorie", "Risk Analyst", "", ""), ("b3", "t", "Northwind Laboratories", "Risk Analyst", "Kyiv", ""),
        ("c1", "s", "", "Data Analyst", "", ""), ("c2", "s", "", "Data Analyst", "", ""), ("d1", "s", "Acme", "Fraud Lead", "Paris", ""),
    ])
    assert got == {"a1": "a1", "a2": "a1", "a3": "", "b1": "b1", "b2": "b1", "b3": "", "c1": "", "c2": "", "d1": ""}


@pytest.mark.parametrize("seed", [4, 5])
def test_groups_one_by_one(spark, seed):
    rng = random.Random(seed)
    names = ["Northwind Laboratories", "Northwind Laboratorys", "Northwinds Laboratories", "Contoso", "Contoso Ltd", "Fabrikam Services Group", "Fabrikam Service Group", ""]
    titles = ["Senior Data Analyst Risk", "Senior Data Analysts Risk", "Data Analyst", "Data Analyst (Remote)", "Business Intelligence Analyst", "Business Intelligence Analyst II"]
    places = ["Paris", "Remote", "", "Paris, Berlin", "Berlin", "Berlin, Kyiv", "Kyiv", "Kyiv, Paris", "Rome", "  "]
    rows = [(f"j{i:03}", "s", rng.choice(names), rng.choice(titles), rng.choice(places), rng.choice(["", "", "France"])) for i in range(220)]
    assert grouped(spark, rows) == one_by_one(spark, rows)


def test_groups_of_overlapping_places(spark):
    """One name, places of several words: keys cover members only in part, and what joins depends on all who came before."""
    rng = random.Random(8)
    words = ["paris", "berlin", "kyiv", "rome", "oslo", "delhi"]
    rows = [(f"j{i:03}", "s", "Acme", "Data Analyst", ", ".join(rng.sample(words, rng.randint(1, 3))), "") for i in range(90)]
    rows += [(f"k{i}", "s", "Acme", "Data Analyst", x, "") for i, x in enumerate(["", "Remote", "Europe", " "])]
    rng.shuffle(rows)
    assert grouped(spark, rows) == one_by_one(spark, rows)


def test_group_of_many_profiles(spark):
    """Thousands of profiles that share one place: no pairs of them, one group."""
    rows = [(f"j{i:05}", "s", "Acme", "Data Analyst", f"Town{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efghijklmn'[i // 1000]}", "France") for i in range(4000)]
    assert set(grouped(spark, rows).values()) == {"j00000"}


def test_groups_empty(spark):
    assert grouped(spark, [(None, None, None, None, None, None)]) == {None: ""}
    assert G.duplicate_groups(spark.createDataFrame([], POSTINGS)).count() == 0


@pytest.mark.parametrize(("least", "letters", "longest"), [(0.8, "abc ", 16), (0.92, "ab", 40), (0.93, "abcdefg", 60), (0.7, "abcd", 20)])
def test_similar_names_lose_none(spark, least, letters, longest):
    rng = random.Random(1)
    names = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))).strip() for _ in range(90)} - {""}
    for n in list(names)[:60]:  # and edits of them
        for _ in range(2):
            i = rng.randrange(len(n))
            names.add((n[:i] + rng.choice(["", rng.choice(letters), n[i] + rng.choice(letters)]) + n[i + 1 :]).strip())
    names = sorted(names - {""})
    got = {tuple(r) for r in N.similar_names(spark.createDataFrame([(n,) for n in names], "n string"), "n", least).collect()}
    want = {(a, b) for a in names for b in names if a != b and SequenceMatcher(None, a, b).ratio() >= least}
    assert got == want and want


def test_same_postings_all_pairs(spark):
    rng = random.Random(3)
    titles = ["senior data analyst in the risk team", "senior data analysts in the risk team", "junior data analyst in the risk team", "data analyst"]
    rows = [(f"j{i:03}", "s", rng.choice(["Northwind Laboratories", "Northwind Laboratory", "Contoso"]), rng.choice(titles), rng.choice(["Paris", "Remote", "", "Paris, Berlin", "Berlin"]), "") for i in range(60)]
    frame = spark.createDataFrame(rows, POSTINGS)
    found = [(r["first"], (r["company"], r["title"], tuple(r["places"]), r["blank"])) for r in N.distinct_profiles(N.profiles(frame)).collect()]
    want = {(i, j) for i, p in found for j, q in found if j < i and alike(p, q)}
    assert {tuple(r) for r in N.same_postings(frame).collect()} == want and want


def test_places_all_pairs(spark):
    """Every pair of distinct places has a row, those that no posting may have in common as well."""
    import __spark_entry__ as e
    from jobloom.plans.view import LANDS, PLACES

    got = {(r["a"], r["b"]): r["compatible"] for r in e.queries()["locations_compatible"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {(a, b) for a in PLACES for b in PLACES if a < b} and len(PLACES) == len(LANDS) == 7
    assert not got["Berlin, Germany", "Kyiv, Ukraine"] and not got["", "Berlin, Germany"] and got["", "Europe"] and got["Berlin, Germany", "Europe"]


def test_similar_names_of_common_pieces(spark):
    """Names of one small set of syllables, which share most of their short parts: few of their pairs may reach the edit distance, and none that is similar is lost, within groups as well."""
    rng = random.Random(6)
    parts = ["the", "of", "tion", "and", "ing", "er", "on", "😀", "ß"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    names = [" ".join(word() for _ in range(rng.randint(6, 10))) for _ in range(150)]
    for n in names[:60]:  # and edits of them, up to what is still similar and beyond
        for i in sorted(rng.sample(range(len(n)), rng.randint(1, 5)), reverse=True):
            n = n[:i] + rng.choice(["", n[i] + rng.choice("xt😀"), rng.choice("eo")]) + n[i + 1 :]
        names.append(n)
    rows = [(n, rng.choice("pqr")) for n in dict.fromkeys(names)]
    want = {(a, b) for a, _ in rows for b, _ in rows if a != b and SequenceMatcher(None, a, b).ratio() >= 0.93}
    frame = spark.createDataFrame(rows, "n string, g string")
    assert {tuple(r) for r in N.similar_names(frame, "n", 0.93).collect()} == want and len(want) > 20
    together = spark.createDataFrame([("p", "p"), ("q", "q"), ("r", "r"), ("p", "q"), ("q", "p")], "of string, other string")
    of, near = dict(rows), {("p", "p"), ("q", "q"), ("r", "r"), ("p", "q"), ("q", "p")}
    assert {tuple(r) for r in N.similar_names(frame, "n", 0.93, "g", together).collect()} == {(a, b) for a, b in want if (of[a], of[b]) in near}
    assert N.close_names(frame, "n", 0.93).count() < 0.02 * len(rows) ** 2  # before the edit distance


def test_similar_names_by_slices(spark):
    """Slices of lengths, and of one length by hash, lose no pair and find none twice; rows for each name are fewer than its characters and their places."""
    rng = random.Random(9)
    names = {" ".join("".join(rng.choice("abcdeo") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(6, 10))) for _ in range(30)}
    for n in sorted(names):
        i = rng.randrange(len(n))
        names |= {n[:i] + n[i + 1 :], n[:i] + "x" + n[i + 1 :], n[:i] + "xy" + n[i:]}
    names = sorted(n.strip() for n in names)
    frame = spark.createDataFrame([(0, n, i) for i, n in enumerate(names)], "g int, a string, id long")
    want = {frozenset((a, b)) for a in names for b in names if a < b and max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= 0.93}
    for size in (8, 1000):
        got = [(r["a"], r["b"]) for r in N._met(frame, 0.93, size=size).collect()]
        assert len(got) == len({frozenset(p) for p in got}) and want <= {frozenset(p) for p in got} and len(got) < 3 * len(want)
    rows = frame.select(F.size(N._parts(F.col("a"), F.length("a"), F.floor(2 * F.length("a") * 0.07 / 0.93).cast("int"), 0.93)).alias("r"), F.length("a").alias("n"))
    assert rows.agg((F.sum("r") / F.sum("n")).alias("x")).first()["x"] < 1.3  # three for each character before


def test_cut_frees_shuffle_files(spark):
    """The rows that a write dealt out don't stay on disk after it."""
    import time

    def files():
        return {f for f in map(str, spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")) if "shuffle_" in f and f.endswith(".data")}

    option, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    was = spark.conf.get(option, None)
    freed = cut(spark.range(1000).repartition(3, "id"), "freed", free=True)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(option, None) == was
    assert freed.count() == 1000  # which leaves files of its own
