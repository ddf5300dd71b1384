"""Steps whose size has to follow the input's."""

import os

from pyspark.sql import DataFrame

from bitloom.plans import provenance, semantic


def test_numbered_lines_has_more_files_for_more_text(spark, sf, tmp_path, monkeypatch):
    whole = sorted(provenance.numbered_lines(spark, sf).collect())
    folder = tmp_path / "lines"
    monkeypatch.setattr(provenance, "FILE_BYTES", 20_000)
    monkeypatch.setattr(provenance, "shared_folder", lambda _: f"file://{folder}")
    assert sorted(provenance.numbered_lines(spark, sf).collect()) == whole
    assert len([f for f in os.listdir(folder) if f.startswith("part")]) > 3


def test_soft_relevance_runs_nothing_while_it_is_built(spark, sf, monkeypatch):
    monkeypatch.setattr(DataFrame, "first", lambda self: 1 / 0)
    assert semantic.soft_relevance(spark, sf).count()
