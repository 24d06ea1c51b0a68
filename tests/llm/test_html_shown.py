"""Elements whose text a browser shows."""

import pytest

from steadfold.llm import html


@pytest.mark.parametrize("page, text", [
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds", "so x=1 holds"),
    ("<math><semantics><mi>y</mi><annotation>tex y</annotation></semantics></math>z", "yz"),
    ("<math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr><mtr><mtd>3</mtd></mtr></mtable></math>", "1 2\n3"),
    ("<math><mspace/><mtext>a <b>b</b></mtext></math>c", "a bc"),
    ("a<textarea>\n one &amp; <b>two</b>\nthree</textarea>b", "a\n one & <b>two</b>\nthree\nb"),
    ("<textarea>open &lt;", "open <"), ("<textarea></textarea>x", "x"), ("<textarea hidden>h</textarea>x", "x"),
    ("Size <select><option>small<option selected>large</select> now", "Size\nsmall\nlarge\nnow"),
    ("<select><optgroup label=Fruit><option>fig<optgroup label=Nut><option label=Almond>a</select>", "Fruit\nfig\nNut\nAlmond"),
    ("<select><option>a<option hidden>b</select>", "a"), ("<datalist><option>a</datalist>b", "b"),
    ("<svg><title>t</title><desc>d</desc><style>s</style><script>c</script><text>North</text><text>So<tspan>uth</tspan></text></svg>", "North\nSouth"),
    ("<svg><desc/><title/><rect/><text>kept</text></svg>after", "kept\nafter"), ("<svg/>x", "x"), ("<svg><text>a<p>b", "a\n\nb"),
    ("<svg><foreignObject><p>in</p></foreignObject></svg>out", "in\n\nout"), ("<svg hidden><text>a</text></svg>b", "b"),
    ("<noscript>no</noscript>yes", "yes"), ("<o:p>word</o:p><desc>seen</desc>", "wordseen"),
])
def test_shown(page, text):
    assert html.extract(page) == text
