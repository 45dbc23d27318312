import pyarrow as pa

from lorespark.operators import parsing


def test_a_task_holds_the_events_of_few_pages():
    html = "<html lang='de'><p>a<a href='b#c'>d</a>" + "<p>word</p>" * 300
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(1000)), "html": [html, None, "", "<p>x"] * 250, "url": ["http://h/", None, "http://[", ""] * 250})
    made = list(parsing.parsed(iter([pages])))
    assert max(b.num_rows for b in made) <= 1000 * parsing.PARSED // pages.nbytes and [x for b in made for x in b["page_id"].to_pylist()] == list(range(1000))
    events = [x for b in made for x in b["events"].to_pylist()]
    assert events[0][:5] == [dict(zip(("kind", "tag", "value"), x, strict=True)) for x in [("open", "html", "de"), ("open", "p", None), ("said", "", "a"), ("open", "a", "http://h/b"), ("said", "", "d")]]
    assert all(events[i] == events[i % 4] for i in range(1000)) and events[1] == events[2] == []
