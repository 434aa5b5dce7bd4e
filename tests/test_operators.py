"""Dedup, groups, upsert, reports, sources, sheets and streams."""

from pyspark.sql import functions as F

from jobloom.operators import collection as C
from jobloom.operators import dedup as D
from jobloom.operators import reports as P
from jobloom.sources import feeds as S
from jobloom.sources import tables as T


def test_first_per_key(spark):
    rows = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", "z")], "seq int, k string, v string")
    assert sorted(map(tuple, D.first_per_key(rows, [F.col("k")], [F.col("seq")]).collect())) == [(1, "a", "y"), (2, "b", "z")]


def test_inherit(spark):
    rows = [("1", "A", "g", "Подходит", "ok", ""), ("2", "B", "g", "", "", "old"), ("3", "A", "h", "Подходит", "x", ""), ("4", "B", "h", "Возможно", "y", ""), ("5", "C", "h", "", "", ""), ("6", "C", "", "", "", "")]
    got = {r["job_id"]: r for r in D.inherit_decisions(spark.createDataFrame(rows, "job_id string, source string, duplicate_group string, decision string, main_reason string, review_notes string"), ["decision", "main_reason"]).collect()}
    assert got["2"]["decision"] == "Подходит" and got["2"]["main_reason"] == "ok"
    assert got["2"]["review_notes"] == "old Оценка перенесена с копии A (1): та же вакансия под другой ссылкой."
    assert got["5"]["decision"] == "" and got["6"]["decision"] == ""


COLS = "seq int, key string, job_id string, title string, availability_status string, date_collected string, date_published string, role_family string, status string"


def test_merge(spark):
    old = spark.createDataFrame([(1, "a", "ja", "T", "closed", "2026-01-02", "2026-01-05", "Risk", "existing"), (2, "b", "jb", "T", "active", "2026-01-02", "", "", "new"), (3, "c", "j0", "first", "active", "", "", "", "old"), (4, "c", "jc", "last", "active", "", "", "", "old")], COLS)
    new = spark.createDataFrame([(0, "a", "xx", "T", "active", "2026-02-01", "2026-01-09", "", ""), (0, "c", "", "now", "active", "", "", "", ""), (0, "d", "jd", "T", "active", "2026-02-01", "", "", "")], COLS)
    got = sorted(tuple(r[c] for c in ("key", "job_id", "title", "availability_status", "date_collected", "date_published", "role_family", "status")) for r in D.merge(old, new).collect())
    assert got == [
        ("a", "ja", "T", "closed", "2026-01-02", "2026-01-05", "Risk", "existing"), ("b", "jb", "T", "active", "2026-01-02", "", "", "new"), ("c", "j0", "first", "active", "", "", "", "old"), ("c", "jc", "now", "active", "", "", "", "updated"),
        ("d", "jd", "T", "active", "2026-02-01", "", "", "new"),
    ]


def test_dou_titles(spark):
    cases = [
        ("Data Analyst в Acme, $2000–3000, Київ, віддалено", ("Data Analyst", "Acme", "$2000–3000", ["Київ", "віддалено"])), ("Analyst в Acme, 2-inc, Варшава (Польща)", ("Analyst", "Acme, 2-inc", "", ["Варшава (Польща)"])),
        ("Аналітик в команду в Acme", ("Аналітик в команду", "Acme", "", [])), ("Analyst", ("Analyst", "", "", [])), ("A в B, Київ, $1000", ("A", "B", "$1000", ["Київ"])),
    ]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", S.dou_title(F.col("t")).alias("s"))
    got = {r["i"]: (r["s"]["title"], r["s"]["company"], r["s"]["salary"], r["s"]["places"]) for r in frame.collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_broken_payloads(spark):
    bad = spark.createDataFrame([("{",), ("<rss>",), ("[]",), ("{}",), (None,)], "payload string").withColumns({"company": F.lit("c"), "slug": F.lit("s")})
    for name in ("greenhouse", "lever", "remoteok", "jobicy", "himalayas", "dou", "weworkremotely"):
        assert S.REGISTRY[name](bad).count() == 0
    assert S.djinni(bad, "x").count() == 0
    feeds = [(1, "<rss><channel><item><title>a</title><category>Support</category></item></channel></rss>"), (2, "<rss><channel><item><title>a</title><category> data analyst</category></item></channel></rss>"), (3, "<rss><channel><title>x</title></channel></rss>"), (4, "<rss>"), (5, None)]
    got = S.feed_errors(spark.createDataFrame(feeds, "n int, payload string"), "Data Analyst", ("n",)).collect()
    assert [(r["n"], r["items"]) for r in got] == [(1, 1)] and "ignores its filter" in got[0]["message"]
    told = {r["path"]: r["reason"] for r in S.malformed(bad.where("payload IS NOT NULL").withColumn("path", F.col("payload")), "jobicy").collect()}
    assert told == {"{": "not JSON", "<rss>": "not JSON", "[]": "no list of postings", "{}": "no list of postings"}


def test_djinni_pages(spark):
    """The named link counts, not the logo's; the place with a caption, not the office; without a page the bold text and no place."""
    feed = "<rss><channel>" + "".join(f"<item><title>t{i}</title><link>l{i}</link><description>&lt;strong&gt;Bold&lt;/strong&gt;</description><category>QA</category></item>" for i in range(4)) + "</channel></rss>"
    logo, named = '<a href="/jobs/company-a/" class="picture"> \n</a>', '<a class="n" href="https://x.example/jobs/company-a/">A &amp; B</a>'
    office, where = '<li><span class="location-text">Kyiv</span></li>', '<li class="m"><span class="bold location-text">Ukraine <i>or</i> India</span><div class="font-size-extra-small">x</div></li>'
    pages = spark.createDataFrame([("l0", logo + named + office + where), ("l1", logo + office), ("l2", None), ("l0", "")], "link string, html string")
    got = {r["url"]: (r["company"], r["city_region"]) for r in S.djinni(spark.createDataFrame([(feed,)], "payload string"), "qa ", pages).collect()}
    assert got == {"l0": ("A & B", "Ukraine or India"), "l1": ("Bold", ""), "l2": ("Bold", ""), "l3": ("Bold", "")}


def test_workbooks(spark, tmp_path):
    """Texts of all kinds survive; several books, the first sheet that there is, its last row by order; numbers, shared texts and truths of other writers."""
    import io
    import zipfile

    from jobloom.sources import workbooks as W

    rows = [("a", "1 < 2 & 3", "x\ny\r\nz"), ("b", "  blanks  ", ""), ("c", "über 漢 😀", "003"), ("a", "bad\x01char", "3.0"), (None, None, "last")]
    W.write_workbooks(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, k string, v string, w string"), str(tmp_path / "out"), "Jobs", [F.col("seq")], 2)
    back = W.read_workbooks(spark, str(tmp_path / "out"), ["k", "v", "w", "none"], order="o")
    assert sorted(tuple(r)[:4] for r in back.collect()) == sorted((k or "", (v or "").replace("\x01", ""), w, "") for k, v, w in rows)
    assert {r["k"]: r["w"] for r in T.manual_review(back.withColumnRenamed("k", "job_id"), "o").select(F.col("job_id").alias("k"), "w").collect()} == {"a": "3.0", "b": "", "c": "003"}

    out = io.BytesIO(W.book_bytes("Other", ["k"], []))
    with zipfile.ZipFile(out, "a") as z:
        m = f'xmlns="{W.MAIN}"'
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>k</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si><si><t>w</t></si></sst>")
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>2</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><f>1+1</f><v>2</v></c></row><row><c t="b"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="{W.LINK}"><sheets><sheet name="Other" sheetId="1" r:id="rId1"/><sheet name="raw_jobs" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{W.PACKAGE}/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/s2.xml"/></Relationships>')
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.xlsx").write_bytes(out.getvalue())
    assert [tuple(r) for r in W.read_workbooks(spark, str(tmp_path / "in"), ["k", "w"]).collect()] == [("rich", "2"), ("True", "")]


def test_scan_order(spark, tmp_path):
    """The last row wins over several files, however many tasks read them."""
    for n, rows in enumerate(([("a", "1"), ("b", "2"), ("a", "3")], [("b", 'multi\n"line"')], [("a", "4"), ("c", "5"), ("c", "6")])):
        T.write_csv(spark.createDataFrame(rows, "job_id string, decision string").coalesce(1), str(tmp_path / f"in/{n}"))
    got = T.read_csv(spark, str(tmp_path / "in/*"), ["job_id", "decision"], order="o").repartition(5)
    assert sorted(map(tuple, T.manual_review(got, "o").select("job_id", "decision").collect())) == [("a", "4"), ("b", 'multi\n"line"'), ("c", "6")]


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("3", 'say "hi",\nbye', ""), ("007", "ok", "ü")], "a string, b string, c string")
    T.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(map(tuple, T.read_csv(spark, str(tmp_path / "csv"), ["a", "b", "c"]).collect())) == sorted(map(tuple, rows.collect()))
    folder = tmp_path / "drafts"
    folder.mkdir()
    (folder / "j1.md").write_text(f"x\n---\n\n{T.REVIEW_MARK}\n✅ Одобрено", encoding="utf-8")
    (folder / "j1.pdf").write_bytes(b"%PDF")
    (folder / "j2.md").write_text("x ✅ Одобрено", encoding="utf-8")
    assert sorted(map(tuple, T.drafts(spark, str(folder)).collect())) == [("j1", "approved", True), ("j2", "", False)]


COLS_IN = "key string, job_id string, title string, availability_status string, date_collected string, date_published string, role_family string, status string"


def test_stream_merge(spark, tmp_path):
    from jobloom.streaming.buckets import read_table
    from jobloom.streaming.upsert import merge_stream

    landing, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    seen = []
    for n, title in enumerate(("one", "two", "two")):
        spark.createDataFrame([("a", "ja", title, "active", f"2026-01-0{n + 1}", "", "", "")], COLS_IN).coalesce(1).write.mode("append").parquet(landing)
        merge_stream(spark.readStream.schema(COLS_IN).parquet(landing), table, state).awaitTermination()
        seen += read_table(spark, table).collect()
    assert [(r["title"], r["status"], r["date_collected"]) for r in seen] == [("one", "new", "2026-01-01"), ("two", "updated", "2026-01-01"), ("two", "existing", "2026-01-01")]


def test_buckets_rewritten(spark, tmp_path):
    """A batch of few keys rewrites their buckets alone; a version written twice is the same; earlier versions stay readable."""
    from jobloom.streaming import buckets as B

    table = str(tmp_path / "table")
    rows = lambda keys, title: spark.createDataFrame([(f"k{i}", f"j{i}", title, "active", "2026-01-01", "", "", "") for i in keys], COLS_IN)
    assert B.latest(spark, table) is None
    assert B.upsert(spark, table, rows(range(300), "old"), 0, buckets=20) == list(range(20))
    few = rows([3, 7, 1000], "new")
    hit = {r["b"] for r in few.select(B.bucket_of(F.col("key"), 20).alias("b")).collect()}
    for _ in range(2):  # the second time as after a restart
        assert set(B.upsert(spark, table, few, 1, buckets=20)) == hit
        assert {b for b, v in B.manifest(spark, table, 1).items() if v == 1} == hit
        got = {r["key"]: (r["title"], r["status"]) for r in B.read_table(spark, table).collect()}
        assert len(got) == 301 and got["k3"] == ("new", "updated") and got["k1000"] == ("new", "new") and got["k5"] == ("old", "new")
    assert B.read_table(spark, table, 0).where("title = 'old'").count() == 300
    assert B.latest(spark, table) == 1


def test_recommendations(spark):
    joined = spark.createDataFrame([(i, "Возможно", "", f"T{i}", "dbt; SQL; Crypto", "R") for i in range(3)], "seq int, decision string, should_be_filtered string, title string, required_skills string, preferred_skills string")
    market = spark.createDataFrame([(i, f"C{i}", "dbt certification" if i < 3 else "x", "") for i in range(20)], "seq int, company string, title string, full_text string")
    got = {r["skill"]: r for r in P.recommendations(joined, market).collect()}
    assert set(got) == {"dbt", "R"}
    assert got["dbt"]["action"] == "learn" and got["dbt"]["certs"] == 3 and got["R"]["action"] == "low priority"
    assert got["dbt"]["line"].startswith("LEARN         dbt: near-fit 3, all postings 3 (15%); certificate mentioned in 3 postings")


def test_scan_drafts_whole(spark, monkeypatch):
    """The scan meets every draft of the view, with its verdict and its .pdf; the query gives them all."""
    from jobloom.plans import collection_queries as Q

    scanned, drafts, d = [], T.drafts, "/root/testdata/sf0.001"

    def spy(*a):
        scanned.append(drafts(*a))
        return scanned[-1]

    monkeypatch.setattr(T, "drafts", spy)
    got = sorted(map(tuple, Q.QUERIES["scan_drafts"](spark, d).collect()))
    ids = [r[0] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect()]
    name, verdict = lambda n: f"j{n:08d}", lambda n: "" if n % 2 else "approved"
    assert len(scanned) == 1
    assert sorted(map(tuple, scanned[0].collect())) == sorted((name(n), verdict(n), n % 4 == 0) for n in ids if n % 5 == 0)
    assert got == sorted((name(n), verdict(n), n % 4 == 0) for n in ids if n % 5 == 0)


def test_listing_status(spark):
    """What a whole listing lacks is closed; what one lacks whose page failed, is missing, or whose total isn't told, is unknown."""
    pages = [("a", 1, 25, ["https://x.example/1/"]), ("a", 2, 25, ["https://X.example/2?utm_source=y"]), ("b", 1, 25, ["https://x.example/1"]), ("b", 2, 25, None), ("c", 1, 45, ["https://x.example/1"]), ("c", 3, 45, []), ("d", 1, None, ["https://x.example/1"]), ("e", 1, 0, [])]
    urls, listings = C.company_listing(spark.createDataFrame(pages, "slug string, page int, total int, urls array<string>"))
    saved = spark.createDataFrame([(s, f"https://x.example/{i}") for s in "abcdef" for i in (1, 2, 3)], "slug string, url string")
    got = {(r["slug"], r["url"][-1]): r["status"] for r in C.listing_status(saved, urls, listings).collect()}
    assert [got["a", i] for i in "123"] == ["active", "active", "closed"]
    for s in "bcd":
        assert [got[s, i] for i in "123"] == ["active", "unknown", "unknown"]
    assert {got["e", i] for i in "123"} == {"closed"} and {got["f", i] for i in "123"} == {"unknown"}


def test_ats_presence(spark):
    jobs = [("greenhouse", "g", 7, "https://A.example/p/1?x=2", None), ("lever", "l", None, None, "https://l.example/Q/"), ("bamboohr", "b", 9, None, None)]
    saved = [("Greenhouse", "g", "https://a.example/p/1/", True), ("Greenhouse", "g", "https://own.example/?gh_jid=7", True), ("Greenhouse", "g", "https://own.example/?gh_jid=8", False), ("lever", "l", "https://L.example/Q", True), ("lever", "l", "https://l.example/q", False), ("lever", "l", "https://l.example/?gh_jid=7", False), ("bamboohr", "b", "https://b.example/careers/9", True), ("bamboohr", "c", "https://b.example/careers/9", False)]
    got = C.ats_presence(spark.createDataFrame(saved, "ats string, slug string, url string, want boolean"), spark.createDataFrame(jobs, "ats string, slug string, id long, absolute_url string, hosted_url string")).collect()
    assert len(got) == len(saved) and all(r["present"] == r["want"] for r in got), got


def test_backfill_and_category(spark):
    rows = [("Jobicy", "", "", "Salary 45 000 EUR. Fully remote", "", ""), ("Djinni", "Paris, France", "Unknown", "Salary 45 000 EUR. Fully remote", "", ""), ("Djinni", "Paris", "Hybrid", "Fully remote", "1 USD", "Peru")]
    got = C.backfill(spark.createDataFrame(rows, "source string, city_region string, work_format string, full_text string, salary string, country string")).collect()
    assert [(r["country"], r["work_format"], r["salary"]) for r in got] == [("", "Remote", ""), ("France", "Remote", "45 000 EUR"), ("Peru", "Hybrid", "1 USD")]
    rows = [("LinkedIn", "Fraud Analyst", "data", "x", False), ("LinkedIn", "Business Analyst", "data", "x", True), ("LinkedIn", "Head Chef", "food", "head  chef", True), ("LinkedIn", "Chef", "food", "head chef", False), ("Djinni", "Chef", "data", "x", True)]
    frame = spark.createDataFrame(rows, "source string, title string, job_category string, search_query string, stays boolean")
    assert all(r["stays"] for r in C.category_filter(frame, ("LinkedIn",)).collect()) and C.category_filter(frame, ("LinkedIn",)).count() == 3


def test_dedup_sources(spark):
    rows = [(1, "a", "k"), (2, "a", "k"), (3, "b", "k"), (4, "b", "m"), (0, "c", "k")]
    got = {r["key"]: (r["seq"], r["board"], r["duplicates"], r["across"]) for r in C.dedup_sources(spark.createDataFrame(rows, "seq int, board string, key string"), "board", "key", "seq").collect()}
    assert got == {"k": (0, "c", 0, 2), "m": (4, "b", 0, 0)}


def test_chosen_texts(spark):
    """The first selector with a text wins, then the first element, the outer one of two that begin together; broken markup and nothing at all."""
    from jobloom.functions.html import chosen_texts

    fields = {"a": ("h1", "[class=big]"), "b": ("a[href*=/company/]",), "c": ("[id^=About_]",), "d": ("body",)}
    pages = [
        ('<h1> </h1><p class="x big y">two</p><h1>one</h1>', ("one", "", "", "")), ('<p class="bigger">no</p><p class="big">yes</p>', ("yes", "", "", "")), ('<a href="/company/q/"><img src=x></a><a href="z/company/w">A &amp; <b>B</b></a>', ("", "A &\nB", "", "")),
        ('<div id="About_1">x<div>y<br>z</div>w</div><div id="About_2">n</div>', ("", "", "x\ny\nz\nw", "")), ('<body><div id="About_1"><div id="About_2">in</div>out<script>no()</script>', ("", "", "in\nout", "in\nout")), ("</p></div>", ("",) * 4), (None, ("",) * 4), ("<h1>open <b>ended", ("open\nended", "", "", "")),
    ]
    got = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(pages)], "i int, h string").select("i", chosen_texts(F.col("h"), fields).alias("e")).select("i", "e.*").collect()
    assert {r["i"]: tuple(r)[1:] for r in got} == {i: w for i, (_, w) in enumerate(pages)}
