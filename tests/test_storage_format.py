import pytest
from pyspark.sql import functions as F

from quarry.documents.storage_format import macros_to_html, to_markdown


def macro(name, body="", **parameters):
    return f'<ac:structured-macro ac:name="{name}">' + "".join(f'<ac:parameter ac:name="{k}">{v}</ac:parameter>' for k, v in parameters.items()) + body + "</ac:structured-macro>"


def rich(text):
    return f"<ac:rich-text-body>{text}</ac:rich-text-body>"


def plain(text):
    return f"<ac:plain-text-body><![CDATA[{text}]]></ac:plain-text-body>"


PAGES = {
    # one macro in another, to any depth; a parameter belongs to its own macro
    macro("panel", rich("a" + macro("expand", rich("b" + macro("info", rich("c"))), title="T")), title="P &amp; Q"):
        "<blockquote><p><strong>P &amp; Q</strong></p>a<details><summary>T</summary>b<blockquote><p>ℹ️ </p>c</blockquote></details></blockquote>",
    macro("panel", rich(macro("code", plain("x"), title="inner"))): "<blockquote><pre><code>x</code></pre></blockquote>",
    # raw text is escaped, tags and ends of macros in it are text
    macro("code", plain("if a < b && c: </ac:structured-macro> <p>"), language="c"): '<pre><code class="language-c">if a &lt; b &amp;&amp; c: &lt;/ac:structured-macro&gt; &lt;p&gt;</code></pre>',
    "x <![CDATA[never closed": "x never closed",
    macro("unheard-of", plain("kept")): "<pre>kept</pre>",
    macro("unheard-of", rich("<p>kept</p>")): "<div><p>kept</p></div>",
    macro("unheard-of"): "",
    macro("info"): "",
    macro("toc") + macro("jira", rich("gone")) + "left": "left",
    macro("expand", rich("x")): "<details><summary>펼치기</summary>x</details>",
    macro("excerpt", rich("<p>x</p>")): "<p>x</p>",
    macro("status"): "<span>[STATUS]</span>",
    macro("status", colour="Red", title="A&lt;B"): "<span>[A&lt;B]</span>",
    macro("widget", url="http://a/?b=1&amp;c=2") + macro("widget"): "<p>[EMBED: http://a/?b=1&amp;c=2](http://a/?b=1&amp;c=2)</p>",
    # what is never closed ends with what encloses it; ends without beginnings are passed over
    '<div><ac:structured-macro ac:name="note"><ac:rich-text-body>in</div>after': "<div><blockquote><p>📝 </p>in</blockquote></div>after",
    '<ac:structured-macro ac:name="tip"><ac:rich-text-body><b>open': "<blockquote><p>💡 </p><b>open</b></blockquote>",
    "a</ac:structured-macro></p>b<p>c": "ab<p>c",
    "<ul><li>" + '<ac:structured-macro ac:name="panel"><ac:rich-text-body>x' + "</li><li>y</li></ul>": "<ul><li><blockquote>x</blockquote></li><li>y</li></ul>",
    # images, links, tasks, users
    '<ac:image><ri:url ri:value="http://h/i.png"/></ac:image>': '<img src="http://h/i.png" alt="image"/>',
    "<ac:image/>x": "x",
    '<ac:image><ri:attachment ri:filename="a&quot;b.png"/><ac:caption><p>see <b>it</b></p></ac:caption></ac:image>': '<img src="images/a&quot;b.png" alt="see it"/><p><em>see it</em></p>',
    '<table><tr><th><p><ac:image><ri:attachment ri:filename="t.png"/><ac:caption>c</ac:caption></ac:image></p></th></tr></table>': "<table><tr><th><p>![c](images/t.png) *c*</p></th></tr></table>",
    '<ac:link><ri:page ri:content-title="Far Page"/><ac:plain-text-link-body><![CDATA[go]]></ac:plain-text-link-body></ac:link>': '<a href="#Far Page">go</a>',
    "<ac:link><ac:link-body>only <i>text</i></ac:link-body></ac:link><ac:link/>": "only <i>text</i>",
    '<p>by <ac:link><ri:user ri:account-id="u1"/></ac:link> and <ri:user ri:account-id="u2"/></p>': "<p>by  and <span>@u2</span></p>",
    "<ac:task-list><ac:task><ac:task-id>7</ac:task-id><ac:task-status>complete</ac:task-status><ac:task-body>do <b>it</b></ac:task-body></ac:task><ac:task></ac:task></ac:task-list>": "<ul><li>☑ do it</li><li>☐ </li></ul>",
    "a<ac:placeholder>type here</ac:placeholder><ac:emoticon ac:name=\"smile\"/>b": "ab",
    "1 < 2 <!-- gone --> & &amp;": "1 &lt; 2  & &amp;",
    "": "",
    None: None,
}


def test_pages(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(PAGES)], "i int, page string").repartition(3)
    got = {r.i: r.out for r in rows.select("i", macros_to_html("page").alias("out")).collect()}
    for i, (page, want) in enumerate(PAGES.items()):
        assert got[i].html == want, page


def test_names_of_attachments_in_order(spark):
    page = (
        '<ac:image><ri:attachment ri:filename="1.png"/></ac:image>' + macro("multimedia", '<ac:parameter ac:name="name"><ri:attachment ri:filename="2.MOV"/></ac:parameter>') + macro("view-file", '<ri:attachment ri:filename="3.pdf"/>')
        + '<ac:link><ri:attachment ri:filename="4.webm"/></ac:link><ac:link><ri:attachment ri:filename="5.txt"/></ac:link>' + macro("multimedia")
    )
    out = spark.createDataFrame([(page,)], "page string").select(macros_to_html("page").alias("out")).first().out
    assert (out.images, out.videos) == (["1.png", "3.pdf"], ["2.MOV", "4.webm"])
    assert out.html.count("[VIDEO: 2.MOV](videos/2.MOV)") == out.html.count("[FILE: 3.pdf](images/3.pdf)") == 1


@pytest.mark.parametrize("n", [3000])
def test_deep_and_long_pages(spark, n):
    deep = '<ac:structured-macro ac:name="panel"><ac:rich-text-body>' * n + "core"
    wide = macro("code", plain("x < y\n" * 10)) * 20_000
    odd = '<a "' * 200_000
    rows = spark.createDataFrame([(0, deep), (1, wide), (2, odd)], "i int, page string")
    got = {r.i: r.html for r in rows.select("i", macros_to_html("page")["html"].alias("html")).collect()}
    assert got[0] == "<blockquote>" * n + "core" + "</blockquote>" * n
    assert got[1].count("<pre><code>") == 20_000 and got[2].count("&lt;") == 200_000


def test_markdown(spark):
    page = macro("info", rich("<p>one</p>" + macro("panel", rich("<ul><li>x</li></ul>"), title="T"))) + macro("code", plain("a\n\n\n  b"))
    rows = spark.createDataFrame([("N", page), (None, page), ("E", ""), ("E", None), (None, macro("toc"))], "title string, page string")
    got = [r[0] for r in rows.select(to_markdown(macros_to_html("page")["html"], F.col("title"))).collect()]
    body = "> ℹ️\n>\n> one\n>\n> > **T**\n> >\n> > - x\n\n```\na\n\n\n  b\n```\n"
    assert got == [f"# N\n\n{body}", body, "# E\n\n(빈 페이지)\n", "# E\n\n(빈 페이지)\n", "(빈 페이지)\n"]
