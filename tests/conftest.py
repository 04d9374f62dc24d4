from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pagemill.session import local_session
    s = local_session(4, partitions=4, app="pagemill-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def render(spark):
    """HTML snippets -> Markdown bodies (dict by index), one Spark job per call."""
    from pagemill.config import Config
    from pagemill.plans.convert import html_to_markdown

    def _render(snippets, cfg=None, root="article", wrap=True):
        cfg = cfg or Config()
        rows = []
        for i, h in enumerate(snippets):
            html = f"<html><body><{root}>{h}</{root}></body></html>" if wrap else h
            rows.append((i, f"http://t.test/{i}", html))
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        out = {r.page_id: (r.body if r.extracted else None) for r in html_to_markdown(df, cfg).collect()}
        return [out.get(i) for i in range(len(snippets))]
    return _render
