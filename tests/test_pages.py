"""Pages as text, case by case."""

import pytest
from pyspark.sql import functions as F

from inkgauge.functions import pages

CASES = [
    ("<html><head><title>t</title></head><body><p>One</p><p>two<br>three</p></body></html>", "One\n\ntwo\nthree"),
    ("<script>if (a < b) { x('<p>'); }</script>kept<style>p > a {}</style>", "kept"),
    ("a<!-- <p>no</p> -->b", "ab"),
    ("<div title='a > b'>in</div><span data-x=\"</p>\">out</span>", "in\nout"),
    ("x &lt;b&gt; &amp;lt; &eacute;&#233;&#xE9; &#x1F600; &nosuch; &#0; &#xD800; & alone", "x <b> &lt; ééé 😀 &nosuch; � � & alone"),
    ("a \t  b<p><p><p><p>c", "a b\n\nc"),
    ("<ul><li>one</li><li>two</li></ul>", "one\n\ntwo"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("text<script>never closed", "text"),
    ("", ""),
    (None, None),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_page_text(spark, html, text):
    assert spark.createDataFrame([(html,)], "html string").select(pages.page_text(F.col("html"))).first()[0] == text
