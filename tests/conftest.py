import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from bench import session

    return session(8)


@pytest.fixture
def sales(spark):
    """Build sales rows from dicts; columns not named count as absent from the source."""
    from tillwork.schemas import SALES

    present = {"has_date": "sale_ts", "has_total": "amount", "has_price": "unit_price", "has_qty": "quantity", "has_item": "item", "has_order": "order_ref"}

    def build(*rows, **common):
        named = set(common).union(*rows) if rows else set(common)
        filled = []
        for i, row in enumerate(rows):
            row = {"client_id": "c", "source_id": "s", "row_ix": i, "business_type": "retalho", "is_blank": False, **common, **row}
            for flag, column in present.items():
                row.setdefault(flag, column in named)
            filled.append(tuple(row.get(f) for f in SALES.fieldNames()))
        return spark.createDataFrame(filled, SALES)

    return build
