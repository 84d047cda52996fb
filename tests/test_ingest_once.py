"""Lines of a batch are parsed once, and pushed lines that are equal as one."""

import os

from hitlake.operators import store as W
from hitlake.streaming import jobs as J


def test_lines_are_parsed_once(spark, tmp_path, monkeypatch):
    line = '203.0.0.{} - - [01/Jan/2024:00:00:0{} +0000] "GET /a HTTP/1.1" 200 5 "-" "curl/8"'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(line.format(i % 3, i % 3) for i in range(30)) + "\n")
    base, given, plans = f"file://{tmp_path}/tables", [], []
    parse, as_hits = J.P.parse_lines, J.as_hits

    def parse_lines(lines, fmt):
        given.append(lines.count())
        return parse(lines, fmt)

    def hits(parsed, site):
        out = as_hits(parsed, site)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(J.P, "parse_lines", parse_lines)
    monkeypatch.setattr(J, "as_hits", hits)
    stream = J.stream_lines(spark, f"file://{tmp_path}/in").selectExpr("line", "'web' as source_id")
    J.ingest(stream, base).start().awaitTermination()
    assert given == [3]
    assert len(plans) == 1 and "regexp_replace(translate(" not in plans[0]  # the pattern is not run again for the agents
    assert W.load_tables(spark, base)["hits"].count() == 3
    assert os.listdir(tmp_path / "tables" / "staged") == []
