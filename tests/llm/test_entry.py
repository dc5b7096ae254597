"""The eleven queries are registered."""

import __spark_entry__


def test_registered():
    found = set(__spark_entry__.queries())
    assert "pipeline" in found and all(any(n.startswith(f"op{k}_") for n in found) for k in range(1, 11))
