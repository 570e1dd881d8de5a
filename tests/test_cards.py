"""Choosing the cards of a page, which is read once for all classes."""

from postmill.sources import boards

CARDS, FIELDS = boards.BOARDS["board1"]


def test_a_page_is_read_once_for_all_classes(monkeypatch):
    page = "".join(f'<div class="base-search-card"><a class="base-card__full-link" href="/{i}"></a><h3>t{i}</h3><h4>c &amp; d<br>e</h4></div>' for i in range(40))
    read, feed = [], boards.HTMLParser.feed
    monkeypatch.setattr(boards.HTMLParser, "feed", lambda self, data: (read.append(len(data)), feed(self, data))[1])
    got = boards.choose_cards(page, CARDS, FIELDS)
    assert [(c["title"], c["company"], c["href"]) for c in got] == [(f"t{i}", "c & d e", f"/{i}") for i in range(40)]
    assert read == [len(page)]


def test_classes_without_usable_cards():
    page = '<div class="b"><h3>t</h3></div><div class="a"><h4>c</h4></i></div>'
    assert [c.get("title") for c in boards.choose_cards(page, ["none", "b", "a"], FIELDS)] == ["t"]
    assert [c.get("company") for c in boards.choose_cards("x" + page[31:], ["x", "a"], FIELDS)] == ["c"]
