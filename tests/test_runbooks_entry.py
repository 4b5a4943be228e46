"""Runbook header parsing from files, and the driver contract."""

from secstream.sources.runbooks import read_runbooks

SF = "/root/testdata/sf0.001"


def test_runbook_files(spark, tmp_path):
    (tmp_path / "reverse_shell.txt").write_text(
        "RUNBOOK: Reverse Shell / Interactive Shell Spawned\nSeverity: Critical\n"
        "Tags: reverse-shell, shell, bash, nc\n\nTRIGGER CONDITIONS\n")
    (tmp_path / "plain.txt").write_text("no header here\nat all\n")
    (tmp_path / "late.txt").write_text("a\nb\nc\nd\ne\nRUNBOOK: too late\n")
    (tmp_path / "notes.md").write_text("RUNBOOK: ignored\n")
    rows = {r["runbook_id"]: r.asDict() for r in read_runbooks(spark, str(tmp_path)).collect()}
    assert set(rows) == {"reverse_shell", "plain", "late"}
    rs = rows["reverse_shell"]
    assert rs["title"] == "Reverse Shell / Interactive Shell Spawned"
    assert rs["severity"] == "critical" and rs["tags"] == ["reverse-shell", "shell", "bash", "nc"]
    assert rows["plain"]["title"] == "plain.txt" and rows["plain"]["severity"] == "" and rows["plain"]["tags"] == []
    assert rows["late"]["title"] == "late.txt"


def test_entry_and_contract(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert out.count() > 0
    assert {"group_id", "host", "severity", "event_count"} <= set(out.columns)
    qs, oracles = E.queries(), E.oracle_sql()
    assert set(oracles) <= set(qs)
    assert len(qs) >= 40
    df = qs["incident_report"](spark, SF)
    assert df.count() == 1
