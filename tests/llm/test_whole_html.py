"""Template text of small hosts."""
from arrearscope.llm import htmltext


def page(host, i, text):
    return (host * 1000 + i, f"http://h{host}.com/{i}", f"<html><body><div id=content><h1>Title {i}</h1><p>{text}</p><p>Printed with love</p></div>"
            "<ul><li><a href=/1>first link</a><li><a href=/2>second link</a></ul></body></html>")


def test_template_text_goes_on_hosts_of_every_size(pages):
    sizes = (3, 9, 10, 30)
    rows = [page(n, i, f"words number {i} " * 8) for n in sizes for i in range(n)]
    rows += [page(99, 7, "a page with three addresses " * 5)[:1] + (f"http://h99.com/{k}", page(99, 7, "a page with three addresses " * 5)[2]) for k in range(3)]
    got = htmltext.main_text(pages(rows)).collect()
    for r in got:
        i = r.page_id % 1000
        if r.page_id // 1000 in sizes:
            assert r.text == f"Title {i}\n" + (f"words number {i} " * 8).strip(), r
        else:  # copies of one text show no template
            assert "a page with three addresses" in r.text and "Printed with love" in r.text
    assert len(got) == len(rows)
