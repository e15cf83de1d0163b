import time

import pytest

from reviewlens.llm.warc_derivatives import facts, plain_text

RESPONSE = {"headers": {}}


@pytest.mark.parametrize("part", ["<script>", "<", "<!--", "<a ", "<title>", "<p", "</script", "<head>x", "<html lang="])
def test_broken_pages_take_time_in_proportion(part):
    page = part * (2_000_000 // len(part))
    started = time.monotonic()
    plain_text(page)
    facts(page, RESPONSE)
    assert time.monotonic() - started < 20


@pytest.mark.parametrize("page, text", [
    ("<p>One<br>two</p> three", "One\ntwo\nthree"),
    ("a<!-- b <p> --> c<SCRIPT x='1'>d < e</Script >f", "a c f"),
    ("<head><title>T</title></head><header>h</header>x", "h\nx"),
    ("a <b>b</b>&amp; 1 < 2", "a b& 1 < 2"),
    ("<script>never closed <p>seen</p>", "never closed\nseen"),
    ("", ""),
])
def test_visible_text(page, text):
    assert plain_text(page) == text


def test_facts_of_a_page():
    page = "<html lang='de'><title> A &amp;\n B </title><!-- <a href=no> --><a class=x href='u?a&amp;b'>l</a><A HREF=v>m</A>"
    assert facts(page, RESPONSE) == [("title", "A & B"), ("language", "de"), ("outlink", "u?a&b"), ("outlink", "v")]
