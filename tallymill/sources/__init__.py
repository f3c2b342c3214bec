from tallymill.sources.readers import read_competitor_prices, read_sales, read_segment_sales
from tallymill.sources.writers import write_in_batches, write_table

__all__ = ["read_competitor_prices", "read_sales", "read_segment_sales", "write_in_batches", "write_table"]
