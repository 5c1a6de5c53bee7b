"""Evidence rows are the most and the widest: how often they are written and whether they are moved."""

import pytest
from pyspark.sql import functions as F

from returnlens.catalog.core import market_data, settings
from returnlens.catalog.panels import CUTOFF, PANELS, SPARK_FORMS, Panels
from returnlens.catalog.runs import contribution_order, members
from returnlens.operators import assemble, reports, universe
from returnlens.plans import attribution as plan
from returnlens.session import scratch_path, settle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def panels(spark):
    return Panels(spark, SF)


@pytest.fixture(scope="module")
def attributed(panels):
    runs, parts = plan.attribute(market_data(panels), settings())
    return settle(runs, "kept-runs"), settle(parts, "kept-contributions")


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("methodology", ["legacy", "residual_safety_v1"])
def test_evidence_is_written_once(panels, monkeypatch, methodology):
    written = []

    def noted(df, label, keep=False):
        out = settle(df, label, keep)
        if "evidence_payload" in out.columns:
            written.append((label, out.where("driver = 'event'").count()))
        return out

    monkeypatch.setattr(plan, "settle", noted)
    runs, parts = plan.attribute(market_data(panels), settings(methodology=methodology))
    events = parts.where("driver = 'event'").count()
    assert events and [n for _, n in written if n] == [events]
    # The id formed from the window is the one of the run, and every run has its residual row.
    assert parts.join(runs, "attribution_run_id", "left_anti").isEmpty()
    rest = parts.where("driver = 'unexplained_residual'").select("attribution_run_id", "contribution_bps")
    assert rest.join(runs, "attribution_run_id").where("contribution_bps = unexplained_residual_bps").count() == runs.count() == rest.count()


def test_given_totals_and_ids_change_nothing(panels):
    """Contributions with totals at hand and ids formed from the window are those worked out and looked up."""
    data, chosen = market_data(panels), settings(methodology="residual_safety_v1")
    ready = plan.prepare(data, chosen)
    rows = settle(plan.expanded_rows(data, chosen, ready), "rows")
    plain = assemble.contributions(ready.windows, rows, chosen.cutoff, True)
    runs = assemble.runs(ready.windows, plain, chosen.cutoff, chosen.methodology)
    wanted = assemble.stored_contributions(runs, plain)
    got = plan.attribute(data, chosen)[1]
    assert got.columns == wanted.columns
    # Sums of doubles may differ in their last place with the order they are added in.
    near = [F.round(c, 3).alias(c) if c in ("contribution_bps", "share_of_move") else F.col(c) for c in got.columns if c != "evidence_payload"]
    assert got.select(near).exceptAll(wanted.select(near)).isEmpty() and wanted.select(near).exceptAll(got.select(near)).isEmpty()


def test_summaries_carry_no_evidence(panels, attributed):
    runs, parts = attributed
    rows = universe.summaries(members(panels), runs, parts, panels.classification, panels.price_raw, CUTOFF)
    assert "evidence" not in planned(rows).replace("evidence_count", "").replace("has_evidence", "")
    counted = rows.agg(F.sum("contribution_count"), F.sum("evidence_count")).first()
    latest = universe.latest_runs(runs).select("attribution_run_id")
    mine = parts.join(latest, "attribution_run_id")
    told = mine.where((F.size("evidence") > 0) | (F.col("evidence_payload") != "{}"))
    assert tuple(counted) == (mine.count(), told.count())


def test_few_runs_do_not_move_the_contributions(attributed):
    runs, parts = attributed
    shown = reports.export_rows(runs, parts)
    assert "SortMergeJoin" not in planned(shown) and "LeftOuter" not in planned(shown)
    assert shown.count() == parts.count()


def test_a_run_without_contributions_keeps_a_row(attributed):
    runs, parts = attributed
    one = runs.orderBy("attribution_run_id").first().attribution_run_id
    left = reports.run_details(runs, parts.where(F.col("attribution_run_id") != one))
    lonely = left.where(F.col("attribution_run_id") == one).collect()
    assert len(lonely) == 1 and lonely[0].driver is None and lonely[0].share_of_move is None and lonely[0].window_end
    plain = runs.join(parts.where(F.col("attribution_run_id") != one), "attribution_run_id", "left")
    assert left.columns == plain.columns and left.count() == plain.count()


def test_packed_export_reads_back_the_same(spark, attributed):
    runs, parts = attributed
    rows = reports.export_rows(runs, parts.limit(2000))
    rows = settle(rows, "export-rows")
    sizes, cells = [], []
    for how in ("none", "gzip"):
        path = scratch_path(spark, f"export-{how}")
        reports.write_export(rows, path, compression=how)
        cells.append(spark.read.option("header", True).option("escape", '"').schema(", ".join(f"{c} string" for c in rows.columns)).csv(path))
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv*").load(path)
        sizes.append(files.agg(F.sum("length")).first()[0])
    assert sizes[1] * 4 < sizes[0]
    assert cells[0].exceptAll(cells[1]).isEmpty() and cells[0].count() == cells[1].count() == rows.count()


def test_positions_are_given_before_runs_are_joined(panels):
    """The sort by run moves four columns of a contribution and none of its run's."""
    text = planned(contribution_order(panels))
    assert text.index("Join") < text.index("Window")


def test_half_levels_read_shipments_once(spark, panels):
    """One join gives all four factors; the rows are those of the plain text."""
    assert SPARK_FORMS["half_levels"].count("shipments") == 1
    got = panels.half_levels
    text = PANELS["half_levels"].replace("shipments", "{shipments}").replace("part_halves", "{part_halves}")
    wanted = spark.sql(text, shipments=panels.shipments, part_halves=panels.part_halves)
    assert {f.name: f.dataType for f in got.schema} == {f.name: f.dataType for f in wanted.schema}
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty() and got.count()
