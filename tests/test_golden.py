"""Hand-made cases per operator: known strings, error messages, states and geometry."""

import datetime

import pytest
from pyspark.sql import functions as F

from folioworks.functions import geometry as geo
from folioworks.functions import text as tx
from folioworks.operators import access, annotations, compare, ledger, pages, redact, reports, search, sweeps, text_table
from folioworks.sources import files, forms, urls, xfdf

NOW = datetime.datetime(2024, 5, 15, 12)


def one_page(spark, *lines, revision=1):
    rows = [(revision, 0, "\n".join(lines), [(t, (72.0, 710.0 - 12 * i, 72.0 + 6 * len(t), 720.0 - 12 * i)) for i, t in enumerate(lines)])]
    return spark.createDataFrame(
        rows,
        "revision_id int, page_index int, content string, "
        "spans array<struct<text:string,bounds:struct<x0:double,y0:double,x1:double,y1:double>>>",
    )


@pytest.mark.parametrize(
    "preset,hits,misses",
    [
        ("ssn", ["123-45-6789", "Report SSN 987-65-4321 today"], ["12345", "123-45-678"]),
        ("card", ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"], ["4111"]),
        ("email", ["user+tag@sub.domain.co.uk", "mail jane@example.com"], ["jane@localhost", "jane"]),
        ("phone", ["+1 (555) 123-4567", "555-123-4567"], ["555"]),
        ("iban", ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"], ["GB82"]),
    ],
)
def test_presets(spark, preset, hits, misses):
    for text, expected in [(h, True) for h in hits] + [(m, False) for m in misses]:
        found = search.preset_scan(one_page(spark, text), [preset]).collect()
        assert bool(found) is expected, text
        for hit in found:
            assert text[hit.offset : hit.offset + len(hit.text)] == hit.text


def test_pattern_search_crosses_spans_and_is_case_sensitive(spark):
    page = one_page(spark, "Hello wor", "ld World")
    hit = search.pattern_search(page, "world").collect()
    assert [(h.hit_id, h.offset, h.rect.y0, h.rect.y1) for h in hit] == [("srh-0-0", 6, 698.0, 720.0)]
    assert search.pattern_search(page, "W.rld").count() == 0
    assert search.pattern_search(page, "W.rld", regex=True).count() == 1
    with pytest.raises(ValueError):
        search.pattern_search(page, "[", regex=True)
    with pytest.raises(ValueError):
        search.pattern_search(page, "a*", regex=True)


def test_search_options_and_bounds(spark):
    texts = spark.createDataFrame([(i, f"Page {i + 1}") for i in range(120)], "page_index int, content string")
    book = texts.select(F.lit(1).alias("revision_id"), "page_index", "content", F.expr(
        "array(named_struct('text', content, 'bounds', named_struct('x0', 0.0D, 'y0', 0.0D, 'x1', 1.0D, 'y1', 1.0D)))").alias("spans"))
    found = lambda q, **o: {r.page for r in search.search(book, q, **o).collect()}
    assert found("Page 12") == {12, 120}
    assert found("page 12", whole_word=True) == {12}
    assert found("page", match_case=True) == set()
    assert found("PAGE", page=7) == {7}
    assert found("  ") == set() and found("zzz") == set()
    for q in ["Page", "Page 1", "page 50", "zzz"]:
        assert search.hit_set_difference(
            search.search(book, q).select("revision_id", "page"), search.viewer_pages(book, q)
        ).count() == 0
    accented = search.search(one_page(spark, "İstanbul ünlü", "ÜNLÜ"), "ünlü").orderBy("offset").collect()
    assert [(r.offset, r.bounds.y0) for r in accented] == [(9, 710.0), (14, 698.0)]


def test_marks_masks_and_survivors(spark):
    page = one_page(spark, "call me", "secret 123", "bye").unionByName(
        one_page(spark, "again: secret 123").withColumn("page_index", F.lit(1))
    )
    hits = search.pattern_search(page.where("page_index = 0"), "secret")
    accepted = spark.createDataFrame([(1, "srh-0-0"), (1, "srh-0-0"), (1, "srh-9-9")], "revision_id int, hit_id string")
    marks = redact.marks_for_hits(hits, accepted, hits)
    assert marks.count() == 1
    strings = redact.spans_under_marks(page, marks)
    assert [r.text for r in strings.collect()] == ["secret 123"]
    masked = redact.redact_marks(page, marks)
    assert masked.where("page_index = 0").first().content == "call me\n██████████\nbye"
    survivors = redact.verify_absent(masked, strings).collect()
    assert [(s.found_on, s.same_page) for s in survivors] == [(1, False)]
    assert redact.release_gate(masked, redact.verify_absent(masked, strings)).count() == 0
    assert redact.redact_pattern(page.where("page_index = 0"), r"\d+").first().content == "call me\nsecret ███\nbye"


def test_pattern_redaction_leaves_nothing(spark):
    mail, ssn = search.preset_pattern("email"), search.preset_pattern("ssn")
    page = one_page(spark, "SSN 123-45-6789", "mail jane@ex", "ample.com now")
    both = redact.redact_pattern(redact.redact_pattern(page, ssn), mail)
    row = both.first()
    assert [s.text for s in row.spans] == ["SSN ███████████", "mail ███████", "█████████ now"]
    assert row.content == "\n".join(s.text for s in row.spans)
    leak = page.withColumn("content", F.lit("SSN ███████████\nmail jane@ex\nample.com now"))
    strings = spark.createDataFrame([(1, 0, "123-45-6789"), (1, 0, "jane@example.com"), (1, 0, "nothing")], "revision_id int, page_index int, text string")
    assert {r.text for r in redact.verify_absent(leak, strings).collect()} == {"123-45-6789", "jane@example.com"}
    assert redact.verify_absent(both, strings).count() == 0
    bare = page.withColumn("spans", F.lit(None).cast(page.schema["spans"].dataType))
    assert redact.redact_pattern(bare, ssn).first().content.startswith("SSN ███████████\n")


def test_unknown_xfdf_elements_are_kept(spark, tmp_path):
    (tmp_path / "a.xfdf").write_text(
        '<?xml version="1.0"?>\n<xfdf xmlns="http://ns.adobe.com/xfdf/"><!-- <ink page="9"/> --><annots>\n'
        '<highlight page="0" rect="1,2,3,4" title="ann &amp; > co" flags="print,resolved"><contents>say "hi" &lt;b&gt;</contents>'
        "<reply-to><contents>ok</contents></reply-to></highlight>\n"
        '<redact page="2" rect="1,2,3,4"/><sound page="1"><contents>beep</contents></sound></annots></xfdf>'
    )
    rows = xfdf.read_xfdf(spark, str(tmp_path)).orderBy("page_index").collect()
    assert [(r.page_index, r.kind, r.contents, r.author, r.resolved, r.replies) for r in rows] == [
        (0, "highlight", 'say "hi" <b>', "ann & > co", True, ["ok"]), (1, "sticky_note", "beep", "", False, []), (2, "sticky_note", "", "", False, []),
    ]
    assert xfdf.read_xfdf(spark, str(tmp_path), ["sound"]).count() == 1


def test_broken_and_nested_forms(spark):
    def read(fmt, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
        return [(r["values"], r.error) for r in forms.import_form_values(rows, fmt).orderBy("i").collect()]

    nested = "<< /T (p) /Kids [<< /T (q) /V <4142> >> << /V /Off /T (r) >>] >>"
    assert read("fdf", "/T (a) /T (b) /V (1)", "<</T(a)/V(1)>>", nested, "/T (a) /V (1", "<< /T (a)") == [
        ({"b": "1"}, None), ({"a": "1"}, None), ({"p.q": "AB", "p.r": "Off"}, None), (None, "invalid_fdf"), (None, "invalid_fdf"),
    ]
    frame = "<xfdf><fields>{}</fields></xfdf>"
    empty = frame.format("<field name='a'/><field name='b'><value>1</value></field>")
    nested = frame.format('<field name="p"><field name="q&amp;"><value>x</value></field><field name="r"><value/></field></field>')
    assert read("xfdf", empty, nested, "<xfdf><fields>") == [({"b": "1"}, None), ({"p.q&": "x", "p.r": ""}, None), (None, "invalid_xfdf")]
    assert read("csv", 'a,b\n"x\ny", " z"\n', "a,b\n", 'a\n"x') == [({"a": "x\ny", "b": " z"}, None), (None, "unexpected_format"), (None, "unexpected_format")]
    assert [e for _, e in read("json", '{"a":1} trailing', '{"a":1}] x', '{"a":1}', "12", '{"a":1}{"b":2}')] == [
        "invalid_json", "invalid_json", None, "expected_object", "invalid_json",
    ]


def test_range_specs(spark):
    rows = spark.createDataFrame([("1-3,5", 10), ("1-99", 10), ("", 3), ("3-1", 9), ("0", 9), ("1-2-3", 9), ("x", 9), ("2,2,1", 9)], "spec string, page_count int")
    got = {r.spec: (r.pages, r.error) for r in pages.parse_ranges(rows).collect()}
    assert got["1-3,5"] == ([0, 1, 2, 4], None)
    assert got["1-99"][1] == "page 99 is out of range (document has 10 pages)"
    assert got[""][0] == [0, 1, 2] and got["2,2,1"][0] == [0, 1]
    assert got["3-1"][1] == "range 3-1 is reversed (must be from ≤ to)"
    assert got["0"][1] == "page number 0 must be ≥ 1"
    assert got["1-2-3"][1] == 'invalid range "1-2-3"' and got["x"][1] == 'invalid page number "x"'


def test_splits(spark):
    sizes = spark.createDataFrame([(1, i, s) for i, s in enumerate([50, 60, 200, 10, 10, 80, 10])], "revision_id int, page_index int, byte_size long")
    parts = [r.part for r in pages.split_by_size(sizes, 100).orderBy("page_index").collect()]
    assert parts == [1, 2, 3, 4, 4, 4, 5]
    documents = spark.createDataFrame([(1, 6), (2, 3)], "revision_id int, page_count int")
    outline = spark.createDataFrame([(1, 0, 2), (1, 0, 4), (1, 0, 2), (1, 1, 5), (1, 0, None)], "revision_id int, depth int, page int")
    got = [(r.part, r.first_page, r.last_page, r.error) for r in pages.split_at_bookmarks(documents, outline, 1).orderBy("revision_id", "part").collect()]
    assert got == [(1, 0, 1, None), (2, 2, 3, None), (3, 4, 5, None), (None, None, None, "no bookmarks on level 1")]


def test_outline_keeps_parents_of_kept_children(spark):
    rows = [(1, 1, None, 0, "a", None), (1, 2, 1, 1, "b", 0), (1, 3, None, 0, "c", 1), (1, 4, 3, 1, "d", 0), (1, 5, None, 0, "e", None)]
    outline = spark.createDataFrame(rows, "revision_id int, node_id int, parent_id int, depth int, title string, page int")
    kept = spark.createDataFrame([(1, 0, 4)], "revision_id int, old_idx int, new_idx int")
    got = {(r.title, r.page) for r in pages.filter_outline(outline, kept, 10).collect()}
    assert got == {("a", None), ("b", 14)}


def test_page_numbers_and_labels(spark):
    row = spark.range(1).select(
        *[tx.roman(F.lit(n)).alias(f"r{n}") for n in (1, 4, 9, 1994, 3999, 4000, 0)],
        *[tx.alpha(F.lit(n), False).alias(f"a{n}") for n in (1, 26, 27, 702, 703)],
        tx.format_bytes(F.lit(1_572_864)).alias("mb"), tx.format_bytes(F.lit(1536)).alias("kb"), tx.format_bytes(F.lit(12)).alias("b"),
        tx.kind_label(F.lit("free_text_callout")).alias("kind"), tx.content_preview(F.lit("é" * 60)).alias("preview"),
    ).first()
    assert [row[f"r{n}"] for n in (1, 4, 9, 1994, 3999, 4000, 0)] == ["I", "IV", "IX", "MCMXCIV", "MMMCMXCIX", "4000", "0"]
    assert [row[f"a{n}"] for n in (1, 26, 27, 702, 703)] == ["a", "z", "aa", "zz", "aaa"]
    assert (row.mb, row.kb, row.b, row.kind) == ("1.5 MB", "1.5 KB", "12 B", "Free Text Callout")
    assert row.preview == "é" * 60 + "…"


def words(spark, a, b):
    return compare.text_diff(one_page(spark, a), one_page(spark, b)).orderBy("change").collect()


def test_text_diff(spark):
    assert words(spark, "same text", "same text") == []
    assert [(r["class"], r.text) for r in words(spark, "hello good bye world", "hello world")] == [("deleted", "good bye")]
    assert [(r["class"], r.text) for r in words(spark, "hello world", "hello wonderful world")] == [("inserted", "wonderful")]
    assert words(spark, "Hello, World", "hello world!") == []
    assert [(r["class"], r.text) for r in words(spark, "eins два drei", "eins три drei")] == [("deleted", "два"), ("inserted", "три")]


def test_alignment_is_a_longest_common_subsequence():
    import random

    rng = random.Random(3)
    for _ in range(60):
        a = [rng.choice(["a", "b", "c", ""]) for _ in range(rng.randrange(0, 14))]
        b = [rng.choice(["a", "b", "c", ""]) for _ in range(rng.randrange(0, 14))]
        steps = compare.lcs_steps(a, b)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y != "" else max(table[i][j + 1], table[i + 1][j])
        assert sum(k == "same" for k, _ in steps) == table[-1][-1]
        assert [i for k, i in steps if k != "inserted"] == list(range(len(a)))
        assert [j for k, j in steps if k == "inserted"] == sorted(j for k, j in steps if k == "inserted")
        # walking the table back by the tie rule gives the same steps
        i, j, back = len(a), len(b), []
        while i or j:
            if i and j and a[i - 1] == b[j - 1] != "":
                i, j = i - 1, j - 1
                back.append(("same", i))
            elif j and (i == 0 or table[i][j - 1] >= table[i - 1][j]):
                j -= 1
                back.append(("inserted", j))
            else:
                i -= 1
                back.append(("deleted", i))
        assert steps == back[::-1]


def test_raster(spark):
    def lines(*rows):
        return spark.createDataFrame([(1, 0, y, 3, px) for y, px in enumerate(rows)], "document_id int, page_index int, y int, channels int, px array<int>")

    a = lines([0] * 12, [0] * 12)
    assert compare.diff_ratio(compare.raster_diff(a, a), ["document_id"]).first().ratio == 0.0
    b = lines([0] * 12, [0, 0, 0, 0, 11, 0, 0, 10, 0, 0, 0, 0])
    assert compare.raster_diff(a, b).first()[2:] == (1, 8)
    band = compare.changed_bands(compare.raster_rows(a, b)).first()
    assert (band.x, band.y, band.width, band.height) == (1, 1, 1, 1)
    assert compare.raster_diff(a, lines([0] * 12)).first()[2:] == (8, 8)
    assert compare.raster_diff(a, b.limit(0)).first()[2:] == (0, 0)


def test_geometry(spark):
    d = F.lit
    span = F.struct(d(72.95).alias("x0"), d(719.87).alias("y0"), d(93.43).alias("x1"), d(728.63).alias("y1"))
    row = spark.range(1).select(geo.span_to_css(span, d(792.0), d(612.0), d(90)).alias("s"), geo.convert(d(1.0), d("inches"), d("points")).alias("pt"),
                                geo.format_length(d(2.5), d("cm")).alias("cm")).first()
    assert [round(row.s[k], 2) for k in ("left", "top", "width", "height")] == [719.87, 72.95, 8.76, 20.48]
    assert row.pt == 72.0 and row.cm == "2.50 cm"


def test_url_guard(spark):
    cases = {
        "https://example.com/x": None, "http://localhost/": "localhost", "http://10.0.0.1": "10.0.0.0/8", "http://172.31.1.1": "172.16.0.0/12",
        "http://172.32.1.1": None, "http://192.168.0.9:80": "192.168.0.0/16", "http://[::1]/": "localhost", "http://[fd12::1]": "fc00::/7",
        "http://[fe80::1]": "fe80::/10", "file:///etc/passwd": "Scheme 'file'", "example.com": "missing a scheme",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string").select("url", urls.url_problem(F.col("url")).alias("p")).collect()
    for r in rows:
        assert (r.p is None) if cases[r.url] is None else cases[r.url] in r.p, (r.url, r.p)


def test_form_formats(spark, tmp_path):
    values = {"name": "Ann (A) \\ Bee", "note": 'x, "y" <z> & \'w\'', "line": "a\nb"}
    row = spark.createDataFrame([(1, values)], "id int, values map<string,string>")
    for fmt in forms.FORMATS:
        data = row if fmt != "csv" else row.withColumn("values", F.map_filter("values", lambda k, v: k != "line"))
        expected = data.first()["values"]
        if fmt == "fdf":
            # balanced parentheses are part of a string
            assert forms.fdf_pairs("/T (a (b) c) /V (x \\(y\\))") == {"a (b) c": "x (y)"}
        read = forms.import_form_values(forms.export_form_values(data, fmt), fmt).first()
        assert read["values"] == expected and read.error is None, fmt
    bad = spark.createDataFrame([("[1]",), ("{",), ('{"a": "b"}',)], "text string")
    assert [r.error for r in forms.import_form_values(bad, "json").collect()] == ["expected_object", "invalid_json", None]
    spark.createDataFrame([("a,b,c\n1,,3\n",)], "text string").write.text(str(tmp_path / "csv"))
    assert forms.read_form_files(spark, str(tmp_path / "csv"), "csv").first()["values"] == {"a": "1", "c": "3"}


def notes(spark):
    return spark.createDataFrame(
        [(1, 7, 0, "highlight", "ann", 'say "hi", <b>', True, datetime.datetime(2024, 1, 2, 3, 4, 5)), (2, 7, 2, "strikethrough", None, None, False, None)],
        "annotation_id long, document_id long, page_index int, kind string, author string, contents string, resolved boolean, inserted_at timestamp_ntz",
    ).withColumns({"rect": F.expr("named_struct('x0', 1.0D, 'y0', 2.0D, 'x1', 3.0D, 'y1', 4.0D)"), "color": F.lit("#ff0000"), "opacity": F.lit(1.0)})


def answers(spark):
    return spark.createDataFrame([(10, 1, "ok & fine", datetime.datetime(2024, 1, 3))], "reply_id long, annotation_id long, body string, inserted_at timestamp_ntz")


def read_document(path, document):
    import glob

    return "\n".join(open(f).read().rstrip("\n") for f in sorted(glob.glob(f"{path}/document_id={document}/part-*"))) + "\n"


def test_annotation_files(spark, tmp_path):
    annotations.write_lines(annotations.csv_lines(notes(spark), answers(spark)), str(tmp_path / "csv"))
    lines = read_document(tmp_path / "csv", 7).split("\n")
    assert lines[0] == "﻿Page,Type,Author,Content,Date,Status,Replies,ID"
    assert lines[1] == '1,Highlight,ann,"say ""hi"", <b>",2024-01-02 03:04:05 UTC,Resolved,,1'
    assert lines[2] == ",Reply,,ok & fine,2024-01-03 00:00:00 UTC,,1,10"
    assert lines[3] == "3,Strikethrough,,,,Open,,2"

    annotations.write_lines(annotations.xfdf_lines(notes(spark), answers(spark)), str(tmp_path / "xfdf"))
    folder = tmp_path / "one"
    folder.mkdir()
    (folder / "a.xfdf").write_text(read_document(tmp_path / "xfdf", 7))
    got = {r.kind: r for r in xfdf.read_xfdf(spark, str(folder / "a.xfdf"), ["highlight", "strikeout", "text"]).collect()}
    assert set(got) == {"highlight", "strikethrough"}
    first = got["highlight"]
    assert (first.contents, first.author, first.rect.x1, first.resolved, first.replies) == ('say "hi", <b>', "ann", 3.0, True, ["ok & fine"])

    annotations.write_lines(annotations.fdf_lines(notes(spark), answers(spark)), str(tmp_path / "fdf"))
    fdf = read_document(tmp_path / "fdf", 7)
    offset = int(fdf.split("startxref\n")[1].split("\n")[0])
    assert fdf.encode()[offset : offset + 4] == b"xref"
    assert "/IRT 1 >>]" in fdf and "/Subtype /StrikeOut" in fdf


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7\nx")
    (tmp_path / "b.png").write_bytes(bytes.fromhex("89504E470D0A1A0A00"))
    (tmp_path / "c.txt").write_bytes(b"\xff\xd8\xff")
    found = files.sniff_image(files.ingest_validate(files.read_files(spark, str(tmp_path))))
    got = {r.path[-5:]: (r.status, r.image_type) for r in found.collect()}
    assert got == {"a.pdf": ("ok", "invalid_image"), "b.png": ("invalid_pdf", "png"), "c.txt": ("invalid_pdf", "jpeg")}
    names = spark.createDataFrame([("A.PNG",), ("b.docx",), ("notes.md",), ("x",), (".png",)], "filename string")
    assert [(r.family, r.reader) for r in files.route_format(names).collect()] == [
        ("image", "unknown"), ("office", "docx"), ("text", "md"), ("unknown", "unknown"), ("unknown", "unknown")]
    cells = spark.createDataFrame([("s", 2, "B2", "x"), ("s", 2, "D2", " y "), ("s", 5, "AA5", "z"), ("s", 5, "AA5", "zz")], "sheet_id string, row int, ref string, value string")
    grid = {r.row: (r.is_header, r.cells) for r in files.sheet_grid(cells).collect()}
    assert grid[2] == (True, ["", "x", "", "y"]) and len(grid[5][1]) == 27


def test_signing(spark):
    envelopes = spark.createDataFrame([(1, "sequential"), (2, "parallel"), (3, "sequential")], "envelope_id int, signing_mode string")
    signers = spark.createDataFrame(
        [(1, 1, "signed"), (1, 2, "declined"), (1, 3, "viewed"), (1, 4, "pending"), (2, 1, "pending"), (2, 2, "viewed"), (3, 1, "signed")],
        "envelope_id int, signer_order int, status string",
    )
    assert sorted(tuple(r) for r in ledger.next_signers(envelopes, signers).collect()) == [(1, 3), (2, 1), (2, 2)]
    counts = {r.envelope_id: (r.unsigned, r.complete) for r in ledger.unsigned_count(envelopes, signers).collect()}
    assert counts == {1: (2, False), 2: (2, False), 3: (0, True)}
    events = spark.createDataFrame(
        [(1, i, datetime.datetime(2024, 1, 1, i), e) for i, e in enumerate(["signed", "sent", "signed", "signed", "completed", "signed", "voided"])],
        "envelope_id int, event_id int, occurred_at timestamp_ntz, event string",
    )
    got = [(r.state_after, r.reason) for r in ledger.envelope_replay(events).orderBy("event_id").collect()]
    assert got == [("draft", "envelope_not_sent"), ("sent", None), ("partially_signed", None), ("partially_signed", None),
                   ("completed", None), ("completed", "envelope_already_completed"), ("completed", "invalid_transition")]


def test_sweeps_run_twice_the_same(spark):
    t = datetime.datetime
    envelopes = spark.createDataFrame(
        [(1, "sent", t(2024, 5, 1), None), (2, "partially_signed", t(2024, 5, 18), None), (3, "sent", t(2024, 5, 18), t(2024, 5, 15, 1)), (4, "draft", t(2024, 5, 1), None)],
        "envelope_id int, status string, expires_at timestamp_ntz, last_reminded_at timestamp_ntz",
    )
    once, events = sweeps.expire_envelopes(envelopes, NOW)
    twice, again = sweeps.expire_envelopes(once, NOW)
    assert [r.envelope_id for r in events.collect()] == [1] and again.count() == 0
    assert sorted(once.collect()) == sorted(twice.collect())
    signers = spark.createDataFrame([(2, 1, "pending", True), (2, 2, "viewed", False), (3, 1, "pending", True)], "envelope_id int, signer_order int, status string, has_token boolean")
    sent = sweeps.reminders(envelopes, signers, NOW)
    assert [tuple(r)[::2] for r in sent.collect()] == [(2, 1)]
    assert sweeps.reminders(sweeps.mark_reminded(envelopes, sent, NOW), signers, NOW).count() == 0


def test_retention(spark):
    t = datetime.datetime
    revisions = spark.createDataFrame([(1, 9, t(2024, 4, 1), 1024), (2, 9, t(2024, 4, 2), 5), (3, 8, t(2024, 3, 1), 7)], "revision_id int, document_id int, inserted_at timestamp_ntz, byte_size long")
    pointers = access.current_pointers(revisions)
    pruned = access.prunable_revisions(revisions, pointers, NOW)
    assert access.retention_report(pruned).first() == (1, 1024, "1.0 KB")
    left = revisions.join(pruned.select("revision_id"), "revision_id", "left_anti")
    assert access.prunable_revisions(left, access.current_pointers(left), NOW).count() == 0


def test_licensing_tiers(spark):
    features = sorted({f for fs in access.TIER_FEATURES.values() for f in fs})
    grid = spark.createDataFrame([(t, f) for t in [*access.TIER_FEATURES, "legacy"] for f in features], "tier string, feature string")
    for r in grid.select("tier", "feature", access.tier_allows(F.col("tier"), F.col("feature")).alias("ok")).collect():
        assert r.ok == (r.feature in access.TIER_FEATURES.get(r.tier, access.TIER_FEATURES["standard"]))


def test_coalescing_and_upsert(spark):
    t = datetime.datetime
    ops = [(1, "text.style", 1, 0), (2, "text.style", 1, 500), (3, "text.style", 2, 900), (4, "page.rotate", 2, 1000), (5, "page.rotate", 2, 1100), (6, "annot.update", 2, 5000), (7, "annot.update", 2, 5800)]
    journal = spark.createDataFrame([(i, 9, k, g, t(2024, 1, 1) + datetime.timedelta(milliseconds=ms)) for i, k, g, ms in ops], "op_id int, document_id int, kind string, target int, ts timestamp_ntz")
    assert sorted(r.op_id for r in ledger.coalesce_edits(journal, ["document_id"]).collect()) == [2, 3, 4, 5, 6, 7]
    old = one_page(spark, "old").unionByName(one_page(spark, "kept", revision=2))
    fresh = one_page(spark, "")
    got = {r.revision_id: r.content for r in text_table.upsert(old, fresh).collect()}
    assert got == {1: "", 2: "kept"}


def test_translation_uses_the_cache_once(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, "bad"), (5, "known")], "page int, text string").withColumns({"source_lang": F.lit("en"), "target_lang": F.lit("de")})
    cache = texts.where("text = 'known'").select(reports.cache_key(F.col("text"), F.col("source_lang"), F.col("target_lang")).alias("key"), F.lit("bekannt").alias("output"))
    assert reports.cache_misses(texts, cache).count() == 2

    def provider(text, source, target):
        if text == "bad":
            raise ValueError("no")
        return text.upper()

    got = {r.page: (r.translated, r.error) for r in reports.translated_pages(texts, cache, provider).collect()}
    assert got == {1: ("A", None), 2: ("A", None), 3: ("", None), 4: (None, "no"), 5: ("bekannt", None)}


def test_reading_order_files(spark, tmp_path):
    import glob

    book = one_page(spark, "a", "b").unionByName(one_page(spark, "c", "d").withColumn("page_index", F.lit(1)))
    text_table.write_reading_order(book, str(tmp_path / "texts"))
    parts = sorted(glob.glob(str(tmp_path / "texts" / "revision_id=1" / "part-*")))
    assert "".join(open(p).read() for p in parts) == "ab\ncd\n"


def test_aligned_words_travel_alone(spark):
    """Only the words' keys cross to Python; text and boxes stay in Spark's rows."""
    box = {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}
    schema = "revision_id long, page_index int, content string, spans array<struct<text: string, bounds: struct<x0: double, y0: double, x1: double, y1: double>>>"
    old = spark.createDataFrame([(i, 0, "a b c", [("a b c", box)]) for i in range(150)], schema)
    new = spark.createDataFrame([(i, 0, "a d c", [("a d c", box)]) for i in range(150)], schema)
    diff = compare.text_diff(old, new)
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    assert sorted((r.revision_id, r.text) for r in diff.collect()) == sorted((i, w) for i in range(150) for w in "bd")


def test_token_delta_shuffles_pages(spark):
    """One row a page and side is shuffled, not one a word; repeated pages, pages of one side and empty words as before."""
    schema = "revision_id long, page_index int, content string, spans array<struct<text: string, bounds: struct<x0: double, y0: double, x1: double, y1: double>>>"
    page = lambda i, text: (i, 0, text, None if text is None else [(text, None)])
    old = spark.createDataFrame([page(1, "a A! b"), page(1, "a"), page(2, "x --"), page(4, None)], schema)
    new = spark.createDataFrame([page(1, "b a"), page(3, "y y"), page(None, "z")], schema)
    got = {(r.revision_id, r.key, r.removed, r.added) for r in compare.token_delta(old, new).collect()}
    assert got == {(1, "a", 2, 0), (2, "x", 1, 0), (3, "y", 0, 2), (None, "z", 0, 1)}
    plan = compare.token_delta(old, new)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_translation_takes_few_texts_at_a_time(spark):
    """Texts reach the provider from Arrow slices, whatever the batch; a failing one keeps its error."""
    misses = spark.range(1000).selectExpr("concat('k', id) AS key", "concat('t', id) AS text", "'en' AS source_lang", "CAST(NULL AS STRING) AS target_lang")

    def provider(text, source, target):
        if text == "t7":
            raise ValueError("seven")
        return f"{text}-{source}-{target}"

    done = reports.translate(misses, provider)
    assert "MapInArrow" in done._jdf.queryExecution().executedPlan().toString()
    got = {r.key: (r.output, r.error) for r in done.collect()}
    assert got == {f"k{i}": (None, "seven") if i == 7 else (f"t{i}-en-None", None) for i in range(1000)}
