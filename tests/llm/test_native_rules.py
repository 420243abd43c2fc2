"""Quality rules, secrets and archives: edge cases, and brute force where the SQL oracle doesn't reach."""

import hashlib
import re

from pyspark.sql import functions as F

from paperloom.llm import archives, common, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(spark):
    prose = "The river was wide and the boat was small, so they waited for the morning.\nThen they went on."
    texts = [None, "", " \n ", prose, f"{prose}\n{prose}", "a b c d e " * 30, "é" * 9000, "Home | About | News | Contact\n" * 5 + prose, "#" * 50 + " word", prose.replace(".", "!!"), " x y"]
    docs = spark.createDataFrame([(i, t, "k", "q") for i, t in enumerate(texts)] + [(3, prose, "k", "q")], "doc_id long, text string, row string, quality string")
    found = quality.clean_lines(docs)
    assert found.columns == ["doc_id", "text", "row", "quality"]
    rows = found.select("doc_id", "quality.*").collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(texts[r.doc_id])
    by = {r.doc_id: r for r in rows}
    assert by[3].kept and by[3].cleaned_text == prose and not by[7].kept and not by[5].kept
    assert quality.clean_lines(docs.limit(0)).count() == 0


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secret_spans_and_ownership(spark):
    value = "4534254f83b7e27b3670756d7cab6da61ccfcea9"
    live = "ghp_" + "aB3" * 12
    texts = [None, "", f'é token = "{value}" and AKIA{"Q7" * 9}', "passwd=token:abcdefgh Secret = abc123 API-KEY: x", f"key {live} here", "AKIAAKIA" + "Z" * 20, "f" * 70_000, "token=secret=abcdef token: key password='longvalue'", *[f"use ghp_{'cD4' * 12} now"] * 4]
    docs = spark.createDataFrame([(i, t, f"src{i % 7}", "en", "b") for i, t in enumerate(texts)] + [(4, texts[4], "src4", "en", "b"), (99, texts[2], None, None, "b")], "doc_id long, text string, source string, lang string, base string")
    rows = secrets.digest(secrets.find_secrets(docs)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = plain_secrets(texts[2] if r.doc_id == 99 else texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        if r.doc_id not in (4,):
            assert r.spans == want
    one = next(r for r in rows if r.doc_id == 4)
    assert one.spans == f"owned:4:{4 + len(live)}" and one.n_live == 1
    copied = next(r for r in rows if r.doc_id == 8)
    assert (copied.n_live, copied.n_example) == (0, 1)
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[4] == "key [OWNED] here" and clean[0] is None and clean[8] == texts[8]
    assert clean[2] == 'é [ASSIGN]" and [ACCESS]'
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_owners_and_repositories_decide_together(spark):
    wide, few, one = ("ghp_" + c * 12 for c in ("aB3", "cD4", "eF5"))
    rows = [(i, wide, "src0", f"l{i}", 0) for i in range(4)] + [(10 + i, few, f"src{i}", "en", 0) for i in range(2)] + [(20 + i, one, "src9", "en", 0) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, owner int")
    found = {r.doc_id: r for r in secrets.digest(secrets.find_secrets(docs)).collect()}
    assert [(found[i].n_live, found[i].n_example, found[i].max_owners, found[i].max_repos) for i in (0, 10, 20)] == [(0, 1, 1, 4), (1, 0, 2, 2), (1, 0, 1, 1)]
    assert found[0].spans == "" and found[20].spans == f"owned:0:{len(one)}"


def test_redaction_keeps_columns_of_any_name(spark):
    rows = [(1, "passwd=abcdefgh x", "s", "l", 17, 1, 2, 3), (1, "passwd=abcdefgh x", "s", "l", 17, 1, 2, 3), (None, None, "s", "l", 0, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, _d int, key int, row int")
    found = secrets.redact(docs, n_chars="n_chars")
    assert found.dtypes == docs.dtypes
    assert sorted(map(str, found.collect())) == sorted(str(r) for r in docs.selectExpr("doc_id", "if(doc_id = 1, '[ASSIGN] x', text) text", "source", "lang", "if(doc_id = 1, 10L, n_chars) n_chars", "_d", "key", "row").collect())


def test_archives_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "ROLL", 2000)
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"text {i % 30} " * 60) for i in range(90)], "page_id long, url string, html string")
    arc = archives.write_arc(pages, f"file://{tmp_path}/a")
    assert archives.one_each(arc, arc.select("path")).rdd.getNumPartitions() == arc.count() > 20
    found = archives.read_warc(archives.convert(arc, f"file://{tmp_path}/w"))
    assert found.rdd.getNumPartitions() > 20 and found.where("record_type = 'response'").count() == 30 and found.count() == 90


def test_facts_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = spark.createDataFrame([(i % 3 if i > 30 else 9, i) for i in range(60)], "k long, i long")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    found = common.with_facts(rows, facts, ["k"], "i")
    assert found.columns == ["k", "i", "top"] and sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.join(facts.drop("n"), "k").collect()))


def test_archives_keep_every_record(spark, tmp_path):
    rows = [(1, "http://a.example/x y", "<p>é</p>", 0), (2, None, "<p>é</p>", 0), (3, "http://b.example/", None, 0), (4, "http://b.example/", "", 0), (5, "http://c.example/", "x\r\n\r\ny\n" * 30_000, 0), (5, "http://c.example/", "x\r\n\r\ny\n" * 30_000, 0), (None, "http://d.example/", "lone", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path int")
    found = sorted(archives.convert_pages(pages, f"file://{tmp_path}/w").collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found] == [(1, 9, "response", None), (2, 9, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 210_000, "response", None), (5, 210_000, "response", None), (None, 4, "response", None)]
    for r in found:
        text = next(t for p, _, t, _ in rows if p == r.page_id)
        assert r.payload_digest == archives.sha1_base32((text or "").encode())
    assert found[0].url == "http://a.example/x%20y" and found[1].url == "unknown:"
    listed = archives.found_files(spark, f"file://{tmp_path}/w/warc", ".warc.gz")
    assert sorted(r.payload_digest for r in archives.read_warc(listed).collect()) == sorted(r.payload_digest for r in found)
    assert archives.convert_pages(pages.limit(0)).count() == 0


def test_both_arc_versions_and_cut_files(tmp_path):
    head = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"
    one = b"filedesc://a 0.0.0.0 20000101000000 text/plain %d\n" % len(head) + head + b"\nhttp://h/ 1.2.3.4 20010203040506 text/html 5\nhello\n\nhttp://h/2 1.2.3.4 20010203040506 text/html 50\ncut"
    (tmp_path / "one.arc").write_bytes(one)
    assert [(f["URL"], c) for f, c in archives.arc_records(f"file://{tmp_path}/one.arc")] == [("http://h/", b"hello")]
    head = b"2 0 x\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    two = b"filedesc://a 0.0.0.0 20000101000000 text/plain 200 - - 0 a %d\n" % len(head) + head + b"\nhttp://h/ 1.2.3.4 20010203040506 text/html 200 - - 120 a 5\nhello\n"
    (tmp_path / "two.arc").write_bytes(two)
    assert [(f["Result-code"], f["Archive-date"], c) for f, c in archives.arc_records(f"file://{tmp_path}/two.arc")] == [("200", "20010203040506", b"hello")]


def test_components(spark):
    edges = [(2, 1), (3, 2), (9, 8), (7, 7), (3, 2), (10, 11), (11, 12), (12, 13), (20, 1)] + [(100 + i, 101 + i) for i in range(60)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame([*edges, (None, 4)], "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 20: 1, 8: 8, 9: 8, 10: 10, 11: 10, 12: 10, 13: 10} | {100 + i: 100 for i in range(61)}
    assert {k: v for k, v in found.items()} | {v: v for v in found.values()} == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
