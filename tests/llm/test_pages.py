"""Main text of pages and WARC archives."""

import gzip
import hashlib
import re
import time
import zipfile

import pytest

from alertweave.llm import htmltext, warc

ARTICLE = "<p>First &amp; best   paragraph of the article, long enough to count.</p><p>Second <a href='/x'>linked</a> paragraph&nbsp;with <b>bold</b> text.</p>"
WANT = "First & best paragraph of the article, long enough to count.\nSecond linked paragraph with bold text."


def page(body, head="<title>T</title><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


LAYOUTS = {
    "article": page(f"<nav><ul><li><a href='/'>Home</a></li></ul></nav><article>{ARTICLE}</article><footer>&copy; site</footer>"),
    "div": page(f"<header>Site name</header><div id='wrap'><div class='post-content p12'>{ARTICLE}</div><div class='sidebar'><p>Other things to read on this site today, many of them.</p></div></div>"),
    "comments": page(f"<main>{ARTICLE}<section class='comments'><div class='comment'><p>{'A very long comment by a reader. ' * 20}</p></div></section></main>"),
    "furniture": page(f"<div class='cookie-notice'><p>We use cookies.</p></div><article><div class='ad'>Buy now</div>{ARTICLE}<form><p>Sign up</p></form><aside><p>Aside</p></aside><script>var x='<p>no</p>'</script><ul class='share'><li>Share</li></ul></article>"),
    "unclosed": page("<article><p><b>First &amp; best   paragraph of the article, long enough to count.<br><p>Second <a href='/x'>linked</a> paragraph&nbsp;with <b>bold</b> text.</article>"),
    "hidden": page(f"<article>{ARTICLE}<p hidden>no</p><p style='display:none'>no</p></article>"),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts(name):
    assert htmltext.Page(LAYOUTS[name]).text(None) == WANT


def test_hosts_agree_on_a_path(spark):
    """A page whose advert is longer than its article follows the path of its host."""
    body = lambda text, other: page(f"<div class='box-1'><p>{text}</p></div><div class='more'><p>{other}</p></div>")
    rows = [(i, f"https://h.example/{i}", body("The article of this page is here. " * 8, "Short.")) for i in range(6)]
    rows.append((9, "https://h.example/9", body("Short article.", "A long text that is somewhere else. " * 8)))
    rows += [(20, None, None), (21, "not a url", ""), (22, "https://other.example/", "plain text <b>only"), (23, None, LAYOUTS["article"])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", htmltext.F.lit("clash"))
    found = {r["page_id"]: r["text"] for r in htmltext.main_text(pages).collect()}
    assert found[9] == "Short article."
    assert (found[20], found[21], found[22], found[23]) == ("", "", "plain text only", WANT)
    assert htmltext.main_text(pages.limit(0)).count() == 0


OUTER = "Title of the page\nA lead that stands outside the inner box."
INNER = "The main text lies in a box of its own, a level deeper. " * 20
LAST = "A closing paragraph after the box."
NESTED = {
    "article": f"<article><h1>Title of the page</h1><p>A lead that stands outside the inner box.</p><div class='body'><p>{INNER}</p></div><p>{LAST}</p></article><p>Outside.</p>",
    "sections": f"<article><section class='intro'><h1>Title of the page</h1><p>A lead that stands outside the inner box.</p></section><section class='depth'><p>{INNER}</p></section><section class='end'><p>{LAST}</p></section></article>",
    "bare sections": f"<div class='x'><section class='intro'><h1>Title of the page</h1><p>A lead that stands outside the inner box.</p></section><section class='depth'><p>{INNER}</p></section><section class='end'><p>{LAST}</p></section></div>",
    "main": f"<main><h1>Title of the page</h1><p>A lead that stands outside the inner box.</p><article><div class='body'><p>{INNER}</p></div></article><div><p>{LAST}</p></div><article><p>Another article.</p></article></main>",
    "box": f"<div class='wrap'><div class='box'><h1>Title of the page</h1><p>A lead that stands outside the inner box.</p><div class='in'><p>{INNER}</p></div><p>{LAST}</p></div><div class='more'><p>Elsewhere.</p></div></div>",
    "title beside": f"<div class='wrap'><div class='top'><h1>Title of the page</h1><p>A lead that stands outside the inner box.</p></div><div class='in'><p>{INNER}</p></div><p>{LAST}</p></div><div class='more'><p>Elsewhere.</p></div>",
    "body": f"<h1>Title of the page</h1><p>A lead that stands outside the inner box.</p><div class='in'><p>{INNER}</p></div><p>{LAST}</p><div class='more'><p>Elsewhere.</p></div>",
}


@pytest.mark.parametrize("name", sorted(NESTED))
def test_text_at_two_levels(spark, name):
    """Title, lead and closing paragraphs outside the winning container stay, alone and by the vote of a host."""
    html = page(f"<nav><p>Furniture.</p></nav>{NESTED[name]}<footer><p>Furniture.</p></footer>")
    want = f"{OUTER}\n{INNER.strip()}\n{LAST}"
    assert htmltext.Page(html).text(None) == want
    pages = spark.createDataFrame([(i, f"https://h.example/{i}", html) for i in range(3)], "page_id long, url string, html string")
    assert {r["text"] for r in htmltext.main_text(pages).collect()} == {want}


def test_archives_round_trip(spark, tmp_path):
    long = "<p>" + "copy " * 50
    rows = [(3, "http://a/ x\r\nY: z", long), (1, None, long), (2, "http://b/ü%41", long), (5, "http://c", "short"), (4, "http://d", "short"), (None, "http://e", None), (7, "http://f", "é" * 5000), (1, "again", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    archives = warc.write_archives(pages, f"file://{tmp_path}/packed")
    found = warc.read_archives(archives, range_bytes=200).collect()
    assert len(found) == len(rows) and sum(r["records"] for r in archives.collect()) == len(rows)
    for r in found:
        html = next(h for p, u, h in rows if (p, u) == (r["page_id"], r["url"])) or ""
        data = html.encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        revisit = html == long and r["page_id"] != 1
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if revisit else ("response", None))
        assert (None if r["payload"] is None else bytes(r["payload"])) == (None if revisit else data)
    path = archives.first()["path"].removeprefix("file://")
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and set(z.namelist()) == {warc.MEMBER, warc.INDEX}
        assert gzip.decompress(z.read(warc.MEMBER)).startswith(b"WARC/1.1\r\n")
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_zip_directories(tmp_path):
    """Plain and ZIP64 archives with comments and other members."""
    for wide in (False, True):
        path = tmp_path / f"{wide}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
            for name, data in (("a.txt", b"abc"), ("dir/b.bin", b"\0" * 1000)):
                with z.open(name, "w", force_zip64=wide) as f:
                    f.write(data)
            z.comment = b"PK comment " * 20
        with path.open("rb") as f:
            members = warc.zip_members(f, path.stat().st_size)
            method, first, n = members["dir/b.bin"]
            f.seek(first)
            assert (method, n, f.read(n)) == (0, 1000, b"\0" * 1000)
        with pytest.raises(ValueError):
            warc.zip_members(path.open("rb"), 40)


def test_zip64_end_record(tmp_path):
    """More members than the 16-bit count holds put the directory's place in the ZIP64 records."""
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for i in range(65_600):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"%d" % i)
    with path.open("rb") as f:
        members = warc.zip_members(f, path.stat().st_size)
        method, first, n = members["m65599"]
        f.seek(first)
        assert len(members) == 65_600 and f.read(n) == b"65599"


def test_revisits_resolve_by_record_id(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}/{i}", "<p>" + f"text {i % 4} " * 40) for i in range(40)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"file://{tmp_path}/ids")
    ids, refers = {}, []
    for r in archives.collect():
        path = r["path"].removeprefix("file://")
        with zipfile.ZipFile(path) as z:
            lines = z.read(warc.INDEX).decode().splitlines()
            assert lines == sorted(lines) and all(re.match(r"\S+ \d{14} \{", line) for line in lines)
        with open(path, "rb") as f:
            for first, lengths in warc.record_ranges(r["path"], 500):
                f.seek(first)
                for head, _, payload in warc.parse_records(f.read(sum(lengths)), lengths):
                    ids[head["warc-record-id"]] = head
                    if head["warc-type"] == "revisit":
                        refers.append(head)
    assert len(ids) == 40 and len(refers) == 36
    for head in refers:
        target = ids[head["warc-refers-to"]]
        assert target["warc-type"] == "response" and target["page-id"] == head["refers-to-page-id"] and target["warc-payload-digest"] == head["warc-payload-digest"]
    ranges = sum(len(list(warc.record_ranges(r["path"], 500))) for r in archives.collect())
    assert warc.read_archives(archives, range_bytes=500).rdd.getNumPartitions() == ranges > 8


def test_archive_of_several_members(spark, tmp_path):
    """An archive of another writer: two WARC members, two indexes with comments, records between which nothing is indexed."""
    path = tmp_path / "other.zip"
    want = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for k in range(2):
            data, lines = b"", ["!meta line"]
            for i in range(4):
                payload = f"payload {k} {i}".encode()
                packed = gzip.compress(warc.record_bytes(10 * k + i, "http://a/", payload, hashlib.sha256(payload).hexdigest()))
                if i != 2:
                    lines.append(f'a)/ 2020 {{"offset": "{len(data)}", "length": "{len(packed)}", "filename": "part{k}.warc.gz"}}')
                    want.append((10 * k + i, payload))
                data += packed
            z.writestr(f"archive/part{k}.warc.gz", data)
            z.writestr(f"indexes/part{k}.cdxj", "\n".join(lines))
    listed = spark.createDataFrame([(f"file://{path}",)], "path string")
    assert sorted((r["page_id"], bytes(r["payload"])) for r in warc.read_archives(listed).collect()) == sorted(want)


def test_small_records_are_read_in_proportion():
    record = gzip.compress(warc.record_bytes(1, "http://a/", b"x" * 40, "0" * 64))
    start = time.perf_counter()
    assert sum(1 for _ in warc.parse_records(record * 12_000, [len(record)] * 12_000)) == 12_000
    assert time.perf_counter() - start < 3


PROSE = "<p>" + "The article has prose of many words in it. " * 8 + "</p>"


@pytest.mark.parametrize("layout", [
    '<article class="post no-comments"><h1>Title</h1>{}</article>',
    '<div class="post has-feedback">{}</div>',
    '<div class="feedback-story">{}</div>',
    '<div id="feedback">{}</div>',
    '<form id="aspnetForm"><div class="nav"><a href="/">Home</a></div><div class="content"><h1>Title</h1>{}</div></form>',
    "<form>{}</form>",
    "<div class=content><svg class='icon'/>{}</div>",
    "<div class=content><iframe src='x'/>{}</div>",
    "<div class=content><select><option>{}</div>",
    "<div class=content><object data=x><canvas>{}</div>",
    "<div class=content><a title='unclosed>link</a>{}</div>",
])
def test_articles_that_stay(layout):
    page = "<html><body><nav><a href=/>Menu</a></nav>" + layout.replace("{}", PROSE) + '<div id="comments"><p>' + "A reader says so. " * 60 + "</p></div><form><label>Your name</label></form></body></html>"
    if layout == '<div id="feedback">{}</div>':  # nothing else tells it from comments: it stays where nothing else has text
        page = page[: page.index('<div id="comments">')]
    text = htmltext.Page(page).text(None)
    assert "prose of many words" in text and "reader says" not in text and "Your name" not in text and "Menu" not in text


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a b='", "<!--", "<iframe>", "<p>x", "<svg/>", "</x><b>", "<", "<![", "</", "<td><li>"])
def test_hostile_pages_are_read_in_proportion(part):
    start = time.perf_counter()
    page = htmltext.Page(part * 30_000 + ">")
    page.votes()
    page.text(None)
    assert time.perf_counter() - start < 3
