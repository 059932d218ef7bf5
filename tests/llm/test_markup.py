import time

import pytest

from marginalia.llm.markup import Rendering, rendered

CASES = [
    ("plain text", set(), "plain text"),
    ("a **bold** b", {"markdown"}, "a bold b"),
    ("*it* _it_ ***both*** ~~gone~~", {"markdown"}, "it it both gone"),
    ("[t](http://x/y_z) ![alt](p.png)", {"markdown"}, "t alt"),
    ("> quote\n> more", {"markdown"}, "quote\nmore"),
    ("| a | b |\n|---|--:|\n| long | 1 |\n", {"markdown"}, "a    | b\nlong | 1\n"),
    ("see [[Note]] and [[p/q|alias]] ![[x.png]]", {"wiki"}, "see Note and alias x.png"),
    ("'''b''' ''i''", {"wiki"}, "b i"),
    ("== Head ==\nx", {"wiki"}, "## Head\nx"),
    ("{{Infobox|name=x|wert=8}}", {"wiki"}, "name: x; wert: 8"),
    ("{| class=wikitable\n|-\n| a || 1\n|}", {"wiki"}, "a | 1"),
    ("[[Datei:a.svg|mini|caption]][[Kategorie:X]]", {"wiki"}, "caption"),
    ("\\textbf{a} \\emph{b \\texttt{c}}\\footnote{d}", {"latex"}, "a b c (d)"),
    ('w\\"ahrend st{\\"o}rt', {"latex"}, "während stört"),
    ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", {"latex"}, "- a\n- b"),
    ("\\subsection{Title}\nx", {"latex"}, "\n## Title\n\nx"),
    ("a\\\\\nb \\noindent c", {"latex"}, "a\nb c"),
    ("\\begin{tabular}{ll}\na & 1 \\\\\nbb & 2\n\\end{tabular}", {"latex"}, "\na  | 1\nbb | 2\n"),
    ("<b>x</b> &amp; y&nbsp;z", {"html"}, "x & y z"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", {"html"}, "- a\n- b\n  - c\n\n"),
    ("<TABLE border=1><TR><TD>a<TD>1<TR><TD>bb<TD>2</TABLE>", {"html"}, "a  | 1\nbb | 2\n\n"),
    ("<p>a<p>b", {"html"}, "a\n\nb\n\n"),
    ("<h3 id='x'>T</h3>t", {"html"}, "### T\n\nt"),
    ("x<!-- no -->y<script>z()</script><span hidden>h</span><i style='display: none'>n</i>", {"html"}, "xy"),
    ("<pre>a\n  b</pre>", {"html"}, "```\na\n  b\n```\n\n"),
    ("<span\n style=\"c\">x</span>", {"html"}, "x"),
    ("one<br/>two", {"html"}, "one\ntwo"),
    ("\\alpha + \\Omega \\leq \\foo", {"latex"}, "α + Ω ≤ \\foo"),
    ("50 \\% of \\textbf{A \\& B}, x\\_y \\#1", {"latex"}, "50 % of A & B, x_y #1"),
    ("{\\bf bold} and \\emph{a {b} c}", {"latex"}, "bold and a {b} c"),
    ("\\begin{verbatim}\n\\textbf{x} **y**\n\\end{verbatim}", {"latex"}, "\n```\n\\textbf{x} **y**\n```\n"),
    ("\\begin{equation}\nE = mc^2\n\\end{equation}", {"latex"}, "$$\nE = mc^2\n$$"),
    ("\\begin{description}\n\\item[A] one\n\\end{description}", {"latex"}, "- A: one"),
    ("\\begin{quote}\\begin{itemize}\\item a\\end{itemize}\\end{quote}", {"latex"}, "- a"),
    ("{{a|{{b|c}}|d}} {{ {x} }}", {"wiki"}, "c; d {{ {x} }}"),
    ("{|\n| a\n{| b", set(), None),
    ("Title\n=====\n\ntext\n\nSub\n---\nmore **b**", {"markdown"}, "# Title\n\ntext\n\n## Sub\nmore b"),
    ("- item\n---\n\na | b\n---\n", set(), None),
    ("<table><tr><td rowspan=2>a<td>1<tr><td>2<tr><td>b<td>3</table>", {"html"}, "a | 1\n  | 2\nb | 3\n\n"),
    ("<table><tr><td>a<td rowspan=2>r<tr><td>b<tr><td colspan=2>w</table>", {"html"}, "a | r\nb |\nw |\n\n"),
    # no markup
    ("```html\n<b>x</b> **y** [[z]]\n```", set(), None),
    ("~~~tex\n\\textbf{x}\n~~~", set(), None),
    ("`kb --all **x**` ok", set(), None),
    ("$c = \\frac{a}{b}$ and $$\\sum x_i$$ and \\( \\alpha \\) and \\[ \\beta \\]", set(), None),
    ("Pfad D:\\kb\\archiv\\x", set(), None),
    ("Kosten $ 308 bis $ 185; $5 to $10", set(), None),
    ("2 * 3 * 4, a < b, 5 > 3, p < 0.06 und n > 9", set(), None),
    ("field last_x_at stays; Wert* ohne; R&D", set(), None),
    ("- a\n* b\n1. c", set(), None),
    ("Matrix [[1, 2], [3, 4]] siehe [2]", set(), None),
    ("", set(), ""),
]


@pytest.mark.parametrize(("source", "kinds", "text"), CASES)
def test_rendering(source, kinds, text):
    r = Rendering(source)
    assert (r.kinds, r.text) == (kinds, source if text is None else text)


def test_hostile_texts():
    for x in ("<b>" * 5000 + "deep", "[[" * 3000, "{{" * 3000, "**" * 3000 + "x", "\\begin{a}" * 500, "`" * 999, "$" * 999, "|-" * 3000, "<" * 3000, "&" * 3000, "\ue000" + "1\ue001 **x**", "'" * 999, "=" * 999, "_" * 999 + "a"):
        assert isinstance(Rendering(x).text, str)
    assert Rendering("<b>" * 5000 + "deep").text == "deep"
    assert Rendering("\ue0000\ue001 **x**").text == "\ue0000\ue001 x"


@pytest.mark.parametrize("part", ["\\(a ", "\\[a ", "{|\n", "{| x\n| a\n", "\\a{", "\\textbf{x ", "{{a|", "\\begin{a}", "\\begin{a}[", "`a ``b ", "$$a ", "$a ", "a.", "_a_b ", "''a ", "**a ", "[a](", "<a x=\"", "<a b ", "</b", "&a", "==a ", "~~a ", "![[a", "> ", "<td rowspan=9>", "\\item[a", "[a]: ", "|-", "<!-", "a\n===\n", "\\end{a}", "#{", "\ue000"])
def test_time_grows_with_the_text(part):
    """Openings without an end, over and over."""
    took = []
    for n in (50_000, 400_000):
        began = time.process_time()
        Rendering(part * (n // len(part)))
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.3


def test_table(spark):
    df = spark.createDataFrame([("a", "**x** <i>y</i>"), ("a", "**x** <i>y</i>"), ("n", None), ("e", ""), (None, "[[z]]")], "id string, content_full string").selectExpr("*", "1 AS text", "2 AS kinds")
    got = [(r.id, r.text, r.kinds) for r in rendered(df).collect()]
    assert got == [("a", "x y", ["html", "markdown"])] * 2 + [("n", None, []), ("e", "", []), (None, "z", ["wiki"])]
    assert rendered(df.limit(0)).count() == 0
