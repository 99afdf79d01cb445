"""Literal documents against the rows worked out for them."""

import literals
import pytest

from compare import assert_same


@pytest.mark.parametrize("name", list(literals.QUERIES))
def test_literal(name, spark, duck, sf_dir):
    assert_same(literals.QUERIES[name](spark, sf_dir), duck.execute(literals.SQL[name]))
