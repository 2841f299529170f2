"""Files of every kind to units and chunks; CSV and Markdown of any size."""

import random
import time

from lakescribe.operators import delimited, extraction, jobs, markdown, markup

SECRET = "a secret of thirty-two characters, for tests only"


def _machine(s):
    """CSV character by character."""
    rows, row, field, quoted, i = [], [], "", False, 0
    s = s.removeprefix("﻿")
    while i < len(s):
        c, after = s[i], s[i + 1 : i + 2]
        if c == '"' and quoted and after == '"':
            field += '"'
            i += 1
        elif c == '"':
            quoted = not quoted
        elif c in ",\r\n" and not quoted:
            row.append(field.strip())
            field = ""
            if c != ",":
                rows += [row] if any(row) else []
                row = []
        else:
            field += c
        i += 1
    row.append(field.strip())
    return rows + ([row] if any(row) else [])


def test_csv_rows_and_pieces():
    rnd = random.Random(2)
    for _ in range(20_000):
        s = "".join(rnd.choice(['"', '"', ",", "\n", "\r", "\r\n", "a", "b ", " ", '""', "﻿"]) for _ in range(rnd.randrange(16)))
        pieces = list(delimited.row_pieces(s, rnd.randrange(1, 6)))
        assert delimited.read_rows(s) == _machine(s) and "".join(pieces) == s
        assert [r for k, p in enumerate(pieces) for r in delimited.read_rows(("\n" if k else "") + p)] == _machine(s)


def test_csv_of_any_size(spark):
    """A cell of a million characters; a text cut into pieces gives the rows it gives whole."""
    long = 'k,v\n\n"' + "x" * 1_000_000 + '",1\n' + "".join(f'{k},"line\n""{k}"""\n,\n' for k in range(5000))
    docs = spark.createDataFrame([(1, long), (2, "a,b"), (3, None), (4, ""), (5, "\n,\n")], "id int, text string")
    whole = {(r["id"], r["row_index"]): r["cells"] for r in markup.parse_csv(docs, ["id"]).collect()}
    cut = {(r["id"], r["row_index"]): r["cells"] for r in markup.parse_csv(docs, ["id"], piece=10_000).collect()}
    assert whole == cut and len(whole) == 5003 and whole[1, 5001] == ["4999", 'line\n"4999"'] and whole[2, 0] == ["a", "b"]


def test_markdown_is_linear():
    for c in ("[", "*", "<", "`", "[a](", "**a", "<script>", "#", "|", "- ", " ", "![", "_ _"):
        began = time.time()
        markdown.markdown_units("# " + c * (1_000_000 // len(c)) + "\n| --- |\n" + c * (100_000 // len(c)))
        assert time.time() - began < 2, c
    assert markdown.plain("![alt](u) [a [b](x) **c *d** `e` <b>f</b> <> __g") == "alt a [b c *d e f <> __g"
    assert [u[:2] for u in markdown.markdown_units("a\n<script>\nx()\n</script>\n<style>\ny")] == [("paragraph", x) for x in ("a", markdown.REMOVED, f"{markdown.REMOVED} y")]


def _docs(spark, rows):
    own = [(k, "u1", "c1", name, "privacy_minimised" if k % 2 == 0 else "standard", data if data is None else bytearray(data)) for k, (name, data) in enumerate(rows)]
    return spark.createDataFrame(own, "document_id long, user_id string, collection_id string, filename string, processing_mode string, content binary")


def test_stages_of_ingest(spark):
    rows = [
        ("a.html", b"<title>T</title><h1>Head</h1><p>one two three<script>x()</script>"),
        ("a.md", b"# Head\n\nsome *words* here"),
        ("a.csv", b'k,v\n1,"a\nb"\n2,\n'),
        ("a.txt", b"Some words\x07 here, enough of them for one odd byte to be few"),
        ("a.txt", b"\xff\xfe not utf-8 text"),
        ("a.html", "<meta charset=latin-1><p>café au lait".encode("latin-1")),
        ("a.pdf", b"%PDF-1.7 rest"),
        ("a.docx", b"PK"),
        ("noname", b"x"),
        (None, b"x"),
        ("a.txt", None),
        ("a.md", b"# "),
        ("a.csv", b"\n,\n"),
        ("a.txt", b"one two three " * 120_000),
    ]
    done = jobs.process(_docs(spark, rows)).cache()
    said = {r["document_id"]: (r["status"], r["failed_stage"], r["error"]) for r in done.collect()}
    ready = ("ready", None, None)
    assert said == {
        0: ready, 1: ready, 2: ready, 3: ready, 4: ("failed", "validating", "invalid_utf8"), 5: ready, 6: ("failed", "validating", "no_extractor"), 7: ("failed", "validating", "content_mismatch"),
        8: ("failed", "validating", "unsupported_type"), 9: ("failed", "validating", "unsupported_type"), 10: ("failed", "validating", "no_text"), 11: ("failed", "extracting", "no_text"), 12: ("failed", "extracting", "no_text"), 13: ("failed", "extracting", "too_many_characters"),
    }
    chunks = jobs.chunks_of(done, SECRET).orderBy("document_id", "chunk_index").collect()
    assert [(r["document_id"], r["content"], r["heading_path"]) for r in chunks] == [
        (0, "Head", ["Head"]), (0, "one two three", ["Head"]), (1, "Head", ["Head"]), (1, "some words here", ["Head"]),
        (2, "Columns: k | v\nRow 2: k: 1; v: a\nb\nRow 3: k: 2; v: [blank]", None), (3, "Some words here, enough of them for one odd byte to be few", None), (5, "café au lait", []),
    ]
    assert {r["embedding_projection"] for r in chunks if r["document_id"] % 2 == 0} == {"privacy_minimised"}
    assert jobs.process(_docs(spark, rows).where("false")).count() == 0


def test_own_extractors(spark):
    """A caller's kinds, and a file that breaks its extractor: its row fails, the others go on."""

    def shout(data):
        if data == b"boom boom boom":
            raise ZeroDivisionError
        if data == b"not that one please":
            raise extraction.Refused("not_liked")
        return [{"block_type": "paragraph", "text": data.decode().upper()}]

    own = extraction.EXTRACTORS | {"markdown": extraction.Extractor("shout", shout)}
    done = jobs.process(_docs(spark, [("a.md", b"boom boom boom"), ("a.md", b"quiet little words"), ("a.md", b"not that one please"), ("a.txt", b"plain old words")]), extractors=own)
    assert [(r["error"], r["units"] and r["units"][0]["text"]) for r in done.orderBy("document_id").collect()] == [("extraction_failed", None), (None, "QUIET LITTLE WORDS"), ("not_liked", None), (None, "plain old words")]
    few = {k: v for k, v in own.items() if k != "text"}
    assert [r["error"] for r in jobs.process(_docs(spark, [("a.txt", b"plain old words")]), extractors=few).collect()] == ["no_extractor"]


def test_no_shuffle_in_ingest(spark):
    plan = jobs.process(_docs(spark, [("a.txt", b"plain old words")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_old_character_references_need_no_semicolon():
    """As parse5 reads them; the SQL of html_units and html_charset knows them with one only."""
    found = markup.html_units("<h1>Rock &amp roll &amp</h1><p>&lt b &amp; c</p>")
    assert [(u[0], u[1]) for u in found] == [("heading", "Rock & roll &"), ("paragraph", "< b & c")]
