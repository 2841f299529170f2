"""Work that costs more than its keys doesn't stay in the one task that reads a small file."""

import pytest

from lakescribe import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["pii_questions", "pii_maps", "markdown_units"])
def test_tasks(spark, name):
    assert registry.queries()[name](spark, SF).rdd.getNumPartitions() > 1
