import pytest

from credence import Network
from credence.network import NetworkError
from credence.operators import counts
from credence.plans import models as m
from credence.sources import adjacency, bif, dot, dsc, samples
from credence.sources.files import write_text
from credence.streaming import counts as streaming

DSC = """belief network "demo"
// a comment
node A
{
  type: discrete[2] = {"n","y"};
}
node B
{
  type: discrete[2] = {"n","y"};
}\r
probability(A)
{
  0.2, 0.8;
}
probability(B | A)
{
  (0): 0.9, 0.1;
  (1): 0.1, 0.9;
}
"""
BIF = """network demo { }
variable A { type discrete [ 2 ] { n, y }; }
variable B { type discrete [ 2 ] { n, y }; property x = 1; }
probability ( A ) { table 0.2, 0.8; } /* sections in any order */
probability ( B | A ) { (n) 0.9, 0.1; (y) 0.1, 0.9; }
"""


def test_dsc_and_bif_agree(spark, tmp_path):
    a, b = dsc.parse(DSC), bif.parse(BIF)
    assert a == b and a.network.name == "demo" and a.network["A"].states == ("n", "y") and [v.id for v in a.network.variables] == [0, 1]
    write_text(spark, (tmp_path / "n.dsc").as_uri(), DSC)
    assert dsc.read(spark, (tmp_path / "n.dsc").as_uri()) == a


@pytest.mark.parametrize("model", [m.PEARL, m.CHAIN, m.FIVE, m.CPT3])
@pytest.mark.parametrize("form", [dsc, bif])
def test_round_trip(form, model):
    again = form.parse(form.spell(model))
    assert [v.name for v in again.network.variables] == [v.name for v in model.network.variables]
    assert [tuple(t.items()) for t in again.tables.values()] == [tuple(sorted(t.items())) for t in model.tables.values()]


def test_parents_in_any_order():
    text = BIF.replace("variable B", "variable C { type discrete [3] { a, b, c }; }\nvariable B").replace("( B | A ) { (n) 0.9, 0.1; (y) 0.1, 0.9; }", "( B | C, A ) { default 0.5, 0.5; (b, y) 0.25, 0.75; }\nprobability ( C ) { table .2 .3 .5; }")
    model = bif.parse(text)
    assert [p.name for p in model.network.parents("B")] == ["A", "C"]
    assert model.row("B", (1, 1)) == (0.25, 0.75) and model.row("B", (0, 0)) == (0.5, 0.5)


@pytest.mark.parametrize("old, new, what", [("(y) 0.1", "(z) 0.1", "no state z"), ("| A )", "| Q )", "no variable Q"), ("[ 2 ] { n, y }; }", "[ 3 ] { n, y }; }", "3] states"), ("0.2, 0.8", "0.2", "1 probabilities"), ("network demo { }", "network demo { } network two { }", "second network"), ("table 0.2", "table x", "not a number")])
def test_bif_errors_have_lines(old, new, what):
    with pytest.raises(NetworkError, match=r"line \d+: .*" + what.replace("[", r"\[")):
        bif.parse(BIF.replace(old, new, 1))


def test_adjacency(spark, tmp_path):
    net = m.FIVE.network
    lines = [r.value for r in adjacency.spell(*net.frames(spark)).orderBy("line_no").collect()]
    assert lines[0] == ",1,2,3,4,5" and lines[1] == "1, ,*,*, , "
    write_text(spark, (tmp_path / "g.csv").as_uri(), "\n".join(lines))
    assert set(adjacency.read(spark, (tmp_path / "g.csv").as_uri(), net.without_edges()).edges) == set(net.edges)


def test_adjacency_skips_cycles(spark, tmp_path):
    write_text(spark, (tmp_path / "g.csv").as_uri(), ",0,1\n0, ,*\n1,*, ")
    assert adjacency.read(spark, (tmp_path / "g.csv").as_uri(), Network.of({"a": 2, "b": 2})).edges == ((0, 1),)


def test_dot():
    text = dot.spell(Network.of({"A": 2, 'B"': 2}, [("A", 'B"')], "demo"))
    assert text.splitlines() == ["digraph demo{", '    Node0 [label="A"];', '    Node1 [label="B\\""];', "    Node0 -> Node1;", "}"]


def test_samples(spark, tmp_path):
    (tmp_path / "w.txt").write_text("12 0 1 0\n\n3\t1  1 1\n 5 0 1 0\n")
    got = samples.read_samples(spark, (tmp_path / "w.txt").as_uri(), "abc", weight_first=True)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 0, 17), (1, 1, 1, 3)]
    raw = samples.read_samples(spark, (tmp_path / "w.txt").as_uri(), "wabc")
    assert raw.count() == 3
    with pytest.raises(Exception, match="not 2 fields"):
        samples.read_samples(spark, (tmp_path / "w.txt").as_uri(), "ab").collect()


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = m.conv(spark, sf_dir)
    rows.repartition(3).write.parquet((tmp_path / "in").as_uri())
    net = m.CONV.network(("turn", "role"))
    seen = []
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet((tmp_path / "in").as_uri())
    query = streaming.fit_stream(stream, net, lambda cpt, batch: seen.append(sorted((r.var_id, r.config, r.state, round(r.p, 9)) for r in cpt.collect())), (tmp_path / "cp").as_uri())
    query.awaitTermination()
    from credence.operators import cpt

    whole = cpt.fit(counts.compress(rows, list(m.CONV.cards)), net)
    assert len(seen) == 3 and seen[-1] == sorted((r.var_id, r.config, r.state, round(r.p, 9)) for r in whole.collect())


def test_windows_drop_late_rows(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = m.ev_codes(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    query = streaming.windowed_counts(stream, ["kind"], "ts", "1 day", "2 days").writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", (tmp_path / "cp").as_uri()).trigger(availableNow=True).start()
    query.awaitTermination()
    closed = spark.table("windows")
    assert 0 < closed.count() and closed.agg({"n": "sum"}).first()[0] < 1000
