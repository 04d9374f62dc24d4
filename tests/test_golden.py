"""Golden HTML -> Markdown pairs, one per rendering rule (derived from the rules the
engine reproduces; deviations are the documented ones)."""

from pagemill.config import Config

CASES = [
    # headings: level, whitespace collapsed, empty dropped
    ("<h2>  Two \n words </h2><h3> </h3><p>x</p>", "## Two words\n\nx"),
    # paragraphs and emphasis; empty emphasis dropped; inner whitespace trimmed
    ("<p>a <strong> b </strong> <em>c</em> <i> </i>d</p>", "a **b** *c* d"),
    ("<p><del>x</del> <s>y</s> <strike>z</strike></p>", "~~x~~ ~~y~~ ~~z~~"),
    # unclosed inline tag ends at the end of its block
    ("<p><b>lead<br><p>next</p>", "**lead**\n\nnext"),
    # line breaks inside a paragraph
    ("<p>a<br>b</p>", "a  \nb"),
    # links: newline after; empty text -> href; empty href -> text
    ("<p>see <a href='/x'>X  y</a>more</p>", "see [X y](/x)\nmore"),
    ("<p><a href='/only'></a></p>", "[/only](/only)"),
    ("<p><a href=''>plain</a></p>", "plain"),
    # inline code: fence longer than the longest run; padding at edges
    ("<p><code>a`b</code></p>", "``a`b``"),
    ("<p><code>`x</code></p>", "`` `x ``"),
    ("<p><code>a ``` b</code></p>", "````a ``` b````"),
    ("<p><code>````</code></p>", "````` ```` `````"),
    # fenced code: raw text, entities decoded, fence >= 3
    ("<pre><code>if (a &lt; b) {\n  x = 1;\n}\n</code></pre>", "```\nif (a < b) {\n  x = 1;\n}\n```"),
    ("<pre>``` inside</pre>", "````\n``` inside\n````"),
    # lists: nested list after inline text, text after the nested list joins the item
    ("<ul><li>A<ul><li>B</li><li>C</li></ul>tail</li><li>D</li></ul>",
     "- Atail\n  - B\n  - C\n\n- D"),
    ("<ol><li>one</li><li></li><li>three</li></ol>", "1. one\n2. \n3. three"),
    ("<ul><li>x<ol><li>y<ul><li>z</li></ul></li></ol></li></ul>", "- x\n  1. y\n    - z"),
    # quotes and rules
    ("<blockquote><p>q1</p><p>q2</p><blockquote>in</blockquote></blockquote><hr><p>after</p>",
     "> q1\n> \n> q2\n> \n> > in\n\n---\n\nafter"),
    # tables: first row is the header, padding, pipes escaped
    ("<table><tr><td>a</td><td>b|c</td></tr><tr><td>1</td></tr></table>", "| a | b\\|c |\n| --- | --- |\n| 1 |  |"),
    ("<table><thead><tr><th>k</th></tr></thead><tbody><tr><td>v <b>bold</b></td></tr></tbody></table>",
     "| k |\n| --- |\n| v bold |"),
    # dropped elements and transparent ones
    ("<div>a<script>var t=\"</p>\";</script><noscript>n</noscript><template>t</template>"
     "<iframe>i</iframe><span>b</span></div>", "ab"),
    ("<p>a<!-- <b>x</b> -->b</p>", "ab"),
    # entities: decoded once; NBSP collapses like other whitespace
    ("<p>&amp;lt; &copy; &#8217; &#x41;</p>", "&lt; © ’ A"),
    ("<p>a&nbsp; b</p>", "a b"),
    # figure and caption
    ("<figure><img src='i.png'><figcaption>cap</figcaption></figure>", "cap"),
    # broken markup survives
    ("<p>a <b unclosed</p>", "a"),
    ("<p>a < b and c > d &unknown; & e</p>", "a < b and c > d &unknown; & e"),
]


def test_golden(render):
    got = render([h for h, _ in CASES])
    for (html, want), g in zip(CASES, got):
        assert g == want, f"{html!r}: {g!r} != {want!r}"


def test_images_enabled(render):
    html = ("<p><img src=' ' data-src='/lazy.png' alt='A [b]' title='say \"x\"'>"
            "<img data-original='/o.png'><img src='data:image/png;base64,AA' alt='no'>"
            "<img src='javascript:alert(1)'></p>")
    got = render([html], Config(include_images=True))[0]
    assert got == '![A \\[b\\]](/lazy.png "say \\"x\\"")![Image](/o.png)'
    assert render([html]) == [""]


def test_many_attributes_do_not_break_the_tokenizer(render):
    attrs = " ".join(f'a{i}="{i}"' for i in range(20000))
    assert render([f"<p {attrs}>text</p>"]) == ["text"]


def test_root_selection_and_exclusion(render):
    page = ("<html><body><nav>N</nav><div id='main-content'><p>keep</p><div class='ad x'>ad</div>"
            "<footer>f</footer></div><article>art</article></body></html>")
    got = render([page], Config(document_root_selector="#main-content, article", ignore_selectors=".ad, footer"),
                 wrap=False)
    assert got == ["keep"]
    # no configured selector matches: main, then article, then body
    assert render([page], Config(document_root_selector="#nope"), wrap=False) == ["art"]
    assert render(["<html><body><p>b</p></body></html>"], Config(document_root_selector="#nope"), wrap=False) == ["b"]
    # no body at all: extraction fails
    assert render(["<p>x</p>"], Config(document_root_selector="#nope"), wrap=False) == [None]
    # blank root: failure, not an empty document
    assert render(["<html><body><article>  <script>x</script> </article></body></html>"], wrap=False) == [None]


def test_child_and_descendant_selectors(render):
    page = ("<html><body><main><section class='s'><div class='k'>direct</div><p><span class='k'>deep</span></p>"
            "</section></main></body></html>")
    assert render([page], Config(document_root_selector="main", ignore_selectors=".s > .k"), wrap=False) == ["deep"]
    # everything matched is removed, but the root still holds markup: empty body, not a failure
    assert render([page], Config(document_root_selector="main", ignore_selectors="section .k"), wrap=False) == [""]
