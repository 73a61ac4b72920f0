from gridspark.llm import line_dedup as L


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "host", 1) for r in rows], "page_id long, url string, html string, host string, lines int")
    return {r.page_id: r for r in L.drop_lines(df, **more).collect()}


def test_ratio_within_a_host(spark):
    page = lambda k, host, extra="": (k, f"http://user@{host}:80/p/{k}?q#x", f"<p>Menu</p><div class='a'>own {k}</div>{extra}<script>var t='</p>';</script><!-- <p>c</p> -->")
    rows = [page(k, "Big.example", "<p>some</p>" if k < 3 else "") for k in range(10)] + [page(100 + k, "small.example") for k in range(3)]
    rows += [(200, None, "<p>Menu</p>"), (201, "no host", None), (202, "http://Big.example/x", ""), (203, "http://big.example", "<p>Menu</p>\n Menu  <br/>x <b>y</b>")]
    got = run(spark, rows, ratio=0.3)
    assert [got[k].text for k in (0, 5)] == ["own 0\nsome", "own 5"]
    assert (got[0].n_lines, got[0].n_dropped, got[0].host) == (3, 1, "big.example")
    assert got[100].text == "own 100"  # small hosts too
    assert got[200].text == "Menu" and got[201].text == "" and got[202].n_lines == 0
    assert (got[203].text, got[203].n_dropped) == ("x y", 2)


def test_ratio_is_exceeded_not_met(spark):
    rows = [(k, "http://h/", "<p>a</p>" if k < 2 else "<p>b</p>" if k < 5 else f"<p>c{k}</p>") for k in range(10)]
    got = run(spark, rows, ratio=0.2)
    assert got[0].text == "a" and got[3].text == "" and got[9].text == "c9"


def test_repeated_and_empty(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, "http://h/", "<p>a</p>")] * 6, "page_id long, url string, html string")
    assert [r.text for r in L.drop_lines(df).collect()] == [""] * 6


def test_malformed_pages_take_linear_time(spark):
    import time

    odd = ["<script>" * 20_000, "<!--" * 40_000, "<p " * 40_000, "<" * 160_000, "</script" * 20_000, "<style x" * 20_000, "<script>" + "</script" * 20_000, "< p" * 50_000]
    run(spark, [(k, "http://h/", "<p>a</p>") for k in range(len(odd))])
    began = time.perf_counter()
    got = run(spark, [(k, "http://h/", x) for k, x in enumerate(odd)])
    took = time.perf_counter() - began
    rest = run(spark, [(k, "http://h/", "<p>a</p>") for k in range(len(odd))])
    assert len(rest) == len(got) == len(odd) and got[0].text == got[1].text == "" and got[3].n_lines == 1
    assert took < 8  # that is all of the query; quadratic patterns took 44 s for the first page alone


def test_hidden_parts():
    import re

    hidden = lambda x: re.sub(L.HIDDEN.replace("\\z", "\\Z"), "", x)
    assert hidden("a<SCRIPT src='x'>y</script >b<style>c</style>d<!-- e -->f") == "abdf"
    assert hidden("a<script>b") == hidden("a<!-- b <script>c</script>") == "a" and hidden("<scripture>a</scripture>") == "<scripture>a</scripture>"
