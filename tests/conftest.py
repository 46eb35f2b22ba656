import base64
import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from adlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def page():
    """Build the HTML of a search page from documents and metadata."""
    def build(docs, metadata=None, entry=None, raw=None):
        queries = [{"state": {"data": {"docs": docs, "metadata": metadata or {}}}}]
        if entry is not None:
            queries.append({"state": {"data": {"result": {"searchEntry": entry}}}})
        text = raw if raw is not None else json.dumps({"queries": queries})
        code = base64.b64encode(text.encode()).decode()
        return f"<html><body><script>var a=1;</script><script type='x'>{code}</script></body></html>"
    return build
