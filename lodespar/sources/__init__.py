"""Readers and writers."""

from .files import info_columns, read_files, read_with_deletes, write_partitions, write_table
from .generate import random_rows
from .text import read_delimited, write_delimited
from .tpch import tpch_table

__all__ = ["info_columns", "random_rows", "read_delimited", "read_files", "read_with_deletes", "tpch_table", "write_delimited", "write_partitions", "write_table"]
