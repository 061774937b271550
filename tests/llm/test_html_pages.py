"""Pages that were lost whole, and pages on which the two passes must decide."""

import pytest

from runloom.llm import html_text

LONG = "The river ran past the mill and it was the work of years that had made the place what it is, as they said to all who came by in the summer of that year."
MORE = "There is a second part of the story, and it is for those who have the time to read it to the end, as it was told by the people of the town in those days."
SHORT = "It was so."


@pytest.mark.parametrize("page, text", [
    (f"<html><head><title>t</title><meta charset=x><body><p>{LONG}</p></body></html>", LONG),
    (f"<head><title>t</title><body><article><p>{LONG}</p></article>", LONG),
    (f"<head><title>t</title><p>{LONG}<p>{MORE}", f"{LONG}\n{MORE}"),
    (f"<body><form id=f action=x><div><article><p>{LONG}</p></article></div></form>", LONG),
    (f"<body><form><p>{LONG}</p><p>{MORE}</p></form>", f"{LONG}\n{MORE}"),
    (f"<article><p>{LONG}</p></article><form><p>{SHORT} the name of you</p></form>", LONG),
    (f'<div title="a hidden gem"><article><p>{LONG}</p></article></div>', LONG),
    (f'<article><p>{LONG}</p><p style="color:red; display: none">{MORE}</p><p hidden>{MORE}</p></article>', LONG),
    (f'<article><p>{LONG}</p></article><div class="user-comments-thread"><p>{MORE}</p></div>', LONG),
])
def test_no_page_is_lost(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("text", [
    "Река текла мимо старой мельницы. Люди приходили сюда каждое лето и рассказывали друг другу длинные истории о прошлом этого места.",
    "这条河流经过古老的磨坊。每年夏天，人们都会来到这里，互相讲述关于这个地方的漫长故事。孩子们在岸边玩耍，直到太阳落山。",
])
def test_languages_without_known_stop_words(text):
    menu = "<ul><li><a href=a>Главная</a></li><li><a href=b>О нас</a></li><li><a href=c>首页</a></li></ul>"
    assert html_text.main_text(f"<body>{menu}<div>{text}</div><div><a href=x>ссылка на страницу о сайте</a></div></body>") == text


def test_the_passes_decide_where_the_markup_does_not():
    """Without an article: long text is good, link lists and keyword lines are bad, and a short line takes the label of the nearest decided block."""
    links = "<div>" + "".join(f"<a href=x>item number {i} of the list</a> " for i in range(9)) + "</div>"
    words = "<div>shoes boots sandals leather cheap discount sizes brands outlet sneakers trainers slippers heels socks laces polish brushes</div>"
    page = f"{links}<div>{SHORT}</div>{words}<div>{LONG}</div><div>{SHORT}</div><div>{MORE}</div>{words}<div>{SHORT}</div>{links}"
    assert html_text.main_text(page) == f"{LONG}\n{SHORT}\n{MORE}"
    found = html_text.blocks_of(page)
    assert [html_text.by_rules(b) for b in found] == [False, None, False, True, None, True, False, None, False]


def test_empty_table_and_clashing_names(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", f"<p>{LONG}</p>", "mine", 5), (1, "u", f"<p>{LONG}</p>", "mine", 5), (None, None, None, None, None), (2, "v", "", "x", 1)]
    df = spark.createDataFrame(rows, schema)
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and html_text.extract(df.limit(0)).count() == 0
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
