"""Main text: pages on which each extractor wins, and what neither takes."""

import re
from html import unescape

from quarry.sources import maintext

LONG = "Cover begins on the day after the first premium has been paid, and it ends when the term does, whatever happens in between. " * 2


def test_density_leaves_link_lists_and_chrome():
    html = f"""<html><head><title>Cover | Site</title><script>var a = "<p>no</p>"</script></head><body><nav><p>{LONG}</p></nav><div><ul>{''.join(f'<li><a href="/{i}">Another page of ours number {i}</a></li>' for i in range(30))}</ul></div>
<div class="x"><article><h1>Cover</h1><h2>When</h2><p>{LONG}<p>See <a href="/f">the form</a> for more.<ul><li>one<li>two</ul><table><tr><td>Age<td>Rate<tr><td>30<td>12</table></article></div><footer><p>{LONG}</p></footer></body></html>"""
    name, title, rows, chrome = maintext.main_text(html)
    assert (name, title) == ("density", "Cover")
    assert rows == [("heading", "When", 2), ("paragraph", LONG.strip(), 0), ("paragraph", "See the form for more.", 0), ("list_item", "one", 0), ("list_item", "two", 0), ("table_row", "Age Rate", 0), ("table_row", "30 12", 0)]
    assert chrome > 2 * len(LONG)


def test_plain_reading_of_link_pages():
    items = "".join(f'<li><a href="/{i}">A guide to cover number {i}</a></li>' for i in range(12))
    name, _, rows, _ = maintext.main_text(f'<body><div class="cookie-bar"><p>{LONG}</p></div><main><h2>Guides</h2><ul>{items}</ul></main><p>outside of main</p></body>')
    assert name == "plain" and len(rows) == 13 and rows[0] == ("heading", "Guides", 2) and rows[1] == ("list_item", "A guide to cover number 0", 0)


def test_failures():
    assert maintext.main_text("")[2] == [("failure", "too little main content", 0)]
    assert maintext.main_text("<div id=app></div><script src=x></script>")[2] == [("failure", "no server-rendered content", 0)]
    assert maintext.main_text("<p>short</p>")[0] == "failed"
    assert maintext.main_text("<div>" * 3000 + f"<p>{LONG}")[0] == "density"


def test_pages(spark, data):
    """Every block's words stand in the page, in order, and no block comes from a navigation list."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = maintext.main_blocks(spark.read.parquet(f"{data}/pages.parquet")).orderBy("page_id", "pos").collect()
    assert {r["page_id"] for r in rows} == set(pages)
    won = {r["extractor"] for r in rows}
    assert "density" in won
    squeeze = lambda s: re.sub(r"\s+", "", unescape(re.sub(r"<!--.*?-->|<(script|style).*?</\1>|<[^>]*>", "", s, flags=re.S)))
    at: dict = {}
    for r in rows:
        if r["kind"] != "failure":
            found = squeeze(pages[r["page_id"]]).find(re.sub(r"\s+", "", r["text"])[:60])
            assert found >= 0
            at.setdefault(r["page_id"], []).append(found)
    assert len(at) >= 0.9 * len(pages)
