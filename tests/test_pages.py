import statistics

import pytest

from querent.operators import borders, layout, pages

WORD = "doc_id long, page int, word_id long, text string, x0 double, x1 double, top double, bottom double, size double, upright boolean"


def word_rows(lines, doc=1, page=1, start=0, size=10.0):
    """(top, [(x0, text), ...]) lines as words of 5 points a letter."""
    out = []
    for top, parts in lines:
        for x0, t in parts:
            out.append((doc, page, start + len(out), t, float(x0), float(x0 + 5 * len(t)), float(top), float(top + 9), size, True))
    return out


def prose(left, tops, width=40, words=4, tag="w"):
    return [(t, [(left + k * width, f"{tag}{int(t)}x{k}") for k in range(words)]) for t in tops]


def test_snapped_subscripts(spark):
    rows = word_rows([(100, [(10, "BERT"), (80, "is")]), (130, [(10, "next")])]) + [(1, 1, 99, "BASE", 32.0, 50.0, 104.0, 110.0, 6.0, True), (1, 1, 98, "far", 32.0, 50.0, 118.0, 124.0, 6.0, True)]
    got = {r.line: r.text for r in layout.lines(spark.createDataFrame(rows, WORD)).collect()}
    assert got == {99: "BERT BASE is", 129: "next", 117: "far"}


def test_word_sizes_from_characters(spark):
    words = spark.createDataFrame(word_rows([(100, [(10, "ab"), (50, "cd")])]), WORD)
    chars = spark.createDataFrame([(1, 1, 10.0, 14.0, 100.0, 9.0), (1, 1, 14.0, 18.0, 102.0, 11.0), (1, 1, 300.0, 305.0, 100.0, 20.0), (1, 1, 50.0, 54.0, 200.0, 5.0)], "doc_id long, page int, x0 double, x1 double, top double, size double")
    got = {r.text: r.size for r in layout.sized(words, chars).collect()}
    assert got == {"ab": statistics.median([9.0, 11.0]), "cd": None}


def test_boxes_and_footnotes(spark):
    words = spark.createDataFrame(word_rows([(100, [(10, "in"), (200, "out")])]), WORD)
    boxes = spark.createDataFrame([(1, 1, 0.0, 90.0, 50.0, 120.0), (1, 2, 0.0, 0.0, 999.0, 999.0)], "doc_id long, page int, bx0 double, btop double, bx1 double, bbottom double")
    assert [r.text for r in layout.outside(words, boxes).collect()] == ["out"]
    sheets = spark.createDataFrame([(1, 1, 600.0, 800.0), (1, 2, 600.0, 800.0)], "doc_id long, page int, width double, height double")
    rules = spark.createDataFrame([(1, 1, 50.0, 150.0, 700.0, 0.5), (1, 1, 50.0, 150.0, 100.0, 0.5), (1, 1, 50.0, 60.0, 600.0, 0.5), (1, 1, 50.0, 150.0, 650.0, 5.0)], "doc_id long, page int, x0 double, x1 double, top double, height double")
    assert {r.page: r.footnote_top for r in layout.footnote_tops(sheets, rules).collect()} == {1: 700.0, 2: 800.0}


def test_gutter_of_two_columns_only(spark):
    tops = range(100, 400, 12)
    two = word_rows(prose(40, tops, 48, 5) + prose(330, tops, 48, 5))
    one = [(2, *r[1:]) for r in word_rows(prose(40, tops, 33, 16))]
    got = {r.doc_id: r.split for r in layout.gutters(spark.createDataFrame(two + one, WORD), 612.0).collect()}
    assert set(got) == {1} and 270 < got[1] < 345


def test_column_bounds_need_two_columns(spark):
    rows = word_rows([(100, [(10, "a"), (100, "b"), (104, "c"), (200, "d")])]) + [(2, 1, 50, "x", 10.0, 20.0, 1.0, 2.0, 9.0, True)]
    got = [(r.n, r.x) for r in layout.column_bounds(spark.createDataFrame(rows, WORD)).orderBy("n").collect()]
    assert got == [(0, 5.0), (1, 95.0), (2, 195.0), (3, 210.0)]


TABLE = [(200, [(150, "NQ"), (200, "WQ"), (250, "QQP")])] + [(215 + 12 * k, [(40, f"Model{k}"), (150, f"4{k}.1"), (195, "[20]"), (200, f"3{k}.2*"), (250, f"7{k}.3")]) for k in range(5)]


def test_unruled_table_under_its_header(spark):
    words = spark.createDataFrame(word_rows(prose(40, (100, 112, 124)) + TABLE + prose(40, (400, 412))), WORD)
    grid, consumed = pages.unruled_tables(words)
    rows = [r.cells for r in grid.orderBy("row_no").collect()]
    assert rows[0] == ["", "NQ", "WQ", "QQP"] and rows[1] == ["Model0", "40.1", "30.2", "70.3"] and len(rows) == 6
    assert consumed.count() == 3 + 25


def test_side_by_side_panels(spark):
    lines = [(215 + 12 * k, [(40, "1"), (80, "2"), (250, "3"), (290, "4")]) for k in range(4)]
    assert layout.panel_splits(spark.createDataFrame(word_rows(lines), WORD)).first().split == pytest.approx((82.5 + 252.5) / 2)
    close = [(215 + 12 * k, [(40, "1"), (80, "2"), (115, "3"), (150, "4")]) for k in range(4)]
    assert layout.panel_splits(spark.createDataFrame(word_rows(close), WORD)).collect() == []


RULE = "doc_id long, page int, x0 double, x1 double, top double, height double"


def test_ruled_table_and_page_text(spark):
    body = [(110 + 12 * k, [(60, f"row{k}"), (250, f"{k}.5"), (400, f"x{k}")]) for k in range(4)]
    lines = [(96, [(60, "name"), (250, "score"), (400, "kind")])] + body
    tail = [(300, [(60, "A"), (80, "para-")]), (312, [(60, "graph"), (100, "Page"), (140, "7"), (160, "ends.")])]
    title = [(1, 1, 900, "Title", 60.0, 120.0, 40.0, 58.0, 20.0, True)]
    rotated = [(1, 1, 901, "stamp", 5.0, 10.0, 300.0, 500.0, 10.0, False)]
    foot = word_rows([(760, [(60, "footnote")])], start=950)
    words = spark.createDataFrame(word_rows(lines + tail) + title + rotated + foot, WORD)
    rules = spark.createDataFrame([(1, 1, 50.0, 550.0, t, 0.5) for t in (92.0, 106.0, 160.0)] + [(1, 1, 50.0, 150.0, 750.0, 0.5)], RULE)
    sheets = spark.createDataFrame([(1, 1, 600.0, 800.0)], "doc_id long, page int, width double, height double")
    grid, boxes = pages.ruled_tables(words, rules, sheets)
    rows = [r.cells for r in grid.orderBy("row_no").collect()]
    assert rows[0] == ["name", "score", "kind"] and rows[1:] == [[f"row{k}", f"{k}.5", f"x{k}"] for k in range(4)]
    assert boxes.count() == 1
    text = pages.page_texts(words, rules, sheets, 600.0).first().text
    assert text == "| name | score | kind |\n| --- | --- | --- |\n" + "\n".join(f"| row{k} | {k}.5 | x{k} |" for k in range(4)) + "\n\n## Title A paragraph ends."


BAR = "doc_id long, page int, x double, top double, bottom double"


def test_bordered_table_comes_before_rules(spark):
    lines = [(104, [(60, "a"), (160, "b"), (260, "c")]), (124, [(60, "wide"), (90, "cell"), (260, "1")]), (144, [(60, "x"), (160, "y"), (260, "2")]), (300, [(60, "outside")])]
    words = spark.createDataFrame(word_rows(lines), WORD)
    rules = spark.createDataFrame([(1, 1, 50.0, 350.0, t, 0.5) for t in (100.0, 120.0, 140.0, 160.0)], RULE)
    full, cut = [(1, 1, x, 99.0, 161.0) for x in (50.0, 250.5, 350.0)], [(1, 1, 150.0, 100.0, 121.0), (1, 1, 150.0, 139.0, 160.0)]
    bars = spark.createDataFrame(full + cut, BAR)
    sheets = spark.createDataFrame([(1, 1, 600.0, 800.0)], "doc_id long, page int, width double, height double")
    grid, boxes = borders.bordered_tables(words, rules, bars)
    assert [r.cells for r in grid.orderBy("row_no").collect()] == [["a", "b", "c"], ["wide cell", "", "1"], ["x", "y", "2"]]
    assert [tuple(r)[2:] for r in boxes.collect()] == [(50.0, 350.0, 100.0, 160.0)]
    text = pages.page_texts(words, rules, sheets, 600.0, bars).first().text
    assert text == "| a | b | c |\n| --- | --- | --- |\n| wide cell |  | 1 |\n| x | y | 2 |\n\noutside"
    assert pages.drawn_tables(words, rules, sheets, bars.limit(0))[0].count() == pages.ruled_tables(words, rules, sheets)[0].count()


def test_two_bordered_tables_and_a_lone_box(spark):
    rules = spark.createDataFrame([(1, 1, a, a + 100, t, 0.5) for a in (50.0, 300.0) for t in (100.0, 120.0, 140.0)] + [(1, 2, 50.0, 90.0, t, 0.5) for t in (10.0, 50.0)], RULE)
    bars = spark.createDataFrame([(1, 1, a + d, 100.0, 140.0) for a in (50.0, 300.0) for d in (0.0, 100.0)] + [(1, 2, x, 10.0, 50.0) for x in (50.0, 90.0)], BAR)
    cells = borders.cell_boxes(rules, bars)
    assert sorted((r.page, r.region, r.x0, r.top) for r in cells.collect()) == [(1, 0, 50.0, 100.0), (1, 0, 50.0, 120.0), (1, 1, 300.0, 100.0), (1, 1, 300.0, 120.0)]
    assert borders.cell_boxes(rules, bars.limit(0)).collect() == []


def test_two_columns_are_read_one_after_the_other(spark):
    tops = range(100, 400, 12)
    words = spark.createDataFrame(word_rows(prose(40, tops, 48, 5, "l") + prose(330, tops, 48, 5, "r")), WORD)
    body = pages.body_text(words, 612.0).first().body.split()
    first_right = next(k for k, w in enumerate(body) if w.startswith("r"))
    assert all(w.startswith("l") for w in body[:first_right]) and all(w.startswith("r") for w in body[first_right:])


def test_captions(spark):
    words = spark.createDataFrame(word_rows([(50, [(10, "Table"), (40, "3:"), (60, "Scores")]), (90, [(10, "text")])]), WORD)
    assert pages.captions(words).first().caption == "Table 3: Scores"


def test_empty_pages(spark):
    words = spark.createDataFrame([], WORD)
    assert layout.lines(words).collect() == [] and layout.gutters(words, 600.0).collect() == []
    assert pages.unruled_tables(words)[0].collect() == []


def counted(spark, words):
    """``words`` and a count of how often their rows are worked out."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return words.mapInArrow(run, words.schema), made


def test_words_are_worked_out_once(spark):
    rows = [("st", 155.0), ("price", 255.0), ("EM", 355.0)]
    cells = [(1, 0, k, t, x, x + 20.0, 103.0, 112.0) for k, (t, x) in enumerate(rows)]
    cells += [(1, 0, 10 * r + c, f"{r}{c}" if c else "row", 55.0 + 100 * c, 75.0 + 100 * c, 103.0 + 14 * r, 112.0 + 14 * r) for r in range(1, 7) for c in range(4)]
    words = spark.createDataFrame(cells, "doc_id long, page int, word_id long, text string, x0 double, x1 double, top double, bottom double")
    own, made = counted(spark, words)
    grid, _ = pages.unruled_tables(own)
    assert grid.count() == 7 and made.value == len(cells)
    rules = spark.createDataFrame([(1, 0, 50.0, 550.0, 100.0 + 14 * r, 0.5) for r in (0, 1, 7)], "doc_id long, page int, x0 double, x1 double, top double, height double")
    sheets = spark.createDataFrame([(1, 0, 600.0, 800.0)], "doc_id long, page int, width double, height double")
    own, made = counted(spark, words)
    grid, _ = pages.ruled_tables(own, rules, sheets)
    assert grid.count() == 7 and made.value == len(cells)


def test_alignment_sends_no_texts(spark):
    from querent.operators import layout

    texts = ["1", "1", None, " ", " ", "x", "3", "2 3", "", "4"]
    lines = [1, 1, 2, 3, 3, 4, 5, 6, 7, 7]
    words = spark.createDataFrame([(1, 0, t, 10.0, 20.0, 30.0 * n) for t, n in zip(texts, lines, strict=True)], "doc_id long, page int, text string, x0 double, x1 double, top double")
    heads = spark.createDataFrame([(1, 0, "h", 10.0, 20.0, 0.0)], words.schema)
    found = layout.alignment(words, heads)
    assert found.first()["score"] == 2 / 7
    assert "collect_list(text" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_cells_are_numbered_with_their_page():
    cells = [(0, 50.0, 90.0, 10.0, 20.0), (0, 90.0, 130.0, 10.0, 20.0), (0, 50.0, 130.0, 20.0, 30.0), (3, 300.0, 310.0, 10.0, 20.0)]
    assert [c[5:] for c in borders.numbered(cells)] == [(0, 0, 2), (0, 1, 2), (1, 0, 2)]


def test_corners_of_many_pages_are_joined_in_slices(spark, monkeypatch):
    """A worker holds a slice's corners as columns: no Python object for each of them, no whole batch at once."""
    held = []
    cells = borders.page_cells
    monkeypatch.setattr(borders, "page_cells", lambda page, *corners: (held.append(len(page)), cells(page, *corners))[1])
    level = "doc_id long, page int, x0 double, x1 double, top double, height double"
    rules = spark.createDataFrame([(d, 0, 50.0, 250.0, 100.0 + 20 * r, 0.5) for d in range(300) for r in range(5)], level)
    bars = spark.createDataFrame([(d, 0, 50.0 + 100 * c, 100.0, 180.0) for d in range(300) for c in range(3)], BAR)
    found = {}
    monkeypatch.setattr(type(rules), "mapInArrow", lambda self, run, schema: found.update(run=run, rows=self) or self)
    borders.cell_boxes(rules, bars)
    batch = found["rows"].toArrow().combine_chunks().to_batches()
    monkeypatch.setattr(borders, "slices", lambda batches: (b.slice(at, 50) for b in batches for at in range(0, b.num_rows, 50)))
    rows = [r for out in found["run"](iter(batch)) for r in out.to_pylist()]
    assert held == [50 * 15] * 6 and len(rows) == 300 * 8
    assert {(r["region"], r["row_no"], r["col"], r["columns"]) for r in rows if r["doc_id"] == 299} == {(0, r, c, 2) for r in range(4) for c in range(2)}


def test_a_cell_whose_nearest_corner_is_missing():
    import numpy as np

    found = [(0, k, r, c, 10.0 * c, 10.0 * r) for k, (r, c) in enumerate([(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2)])]
    page, _, level, upright, x, y = (np.array(v) for v in zip(*found, strict=True))
    _, cells = borders.page_cells(page, level, upright, x, y)
    assert cells.tolist() == [[0, 0, 20, 0, 10], [0, 10, 20, 0, 20], [0, 0, 20, 10, 20]]


def test_boxes_are_not_sent_whole_to_every_executor(spark):
    from querent.session import stored

    boxes = stored(spark.range(300).selectExpr("id AS doc_id", "0 AS page", "50.0D AS bx0", "90.0D AS bx1", "10.0D AS btop", "20.0D AS bbottom"), "boxes")
    words = spark.createDataFrame([(d, 0, 55.0, 60.0, top, top + 4.0) for d in (1, 2, 400) for top in (12.0, 30.0)], "doc_id long, page int, x0 double, x1 double, top double, bottom double")
    rest = layout.outside(words, boxes)
    assert "Broadcast" not in rest._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.top) for r in rest.collect()) == [(1, 30.0), (2, 30.0), (400, 12.0), (400, 30.0)]
