"""Ids of messages, made from what they come from: the same after a restart and under any partitioning.

An id is the first 16 bytes of a SHA-256, as 32 hex digits. Strings go in with their length before
them, in four bytes, so that no two different inputs give the same bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSACTIONS, ACCOUNTS = 0, 1


def _number(c: Column, size: int) -> Column:
    """A whole number in ``size`` bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(c.cast("long")), 2 * size, "0"))


def _named(c: Column) -> Column:
    data = F.encode(c, "UTF-8")
    return F.concat(_number(F.octet_length(data), 4), data)


def _digest(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat(*parts), 256), F.lit(32))


def source_id(client: Column, stream: int, sequence: Column) -> Column:
    """The id of the message that a client numbered ``sequence`` in one of its streams."""
    return _digest(_named(client), _number(F.lit(stream), 1), _number(sequence, 8))


def derived_id(parent: Column, name: str, index: Column | int = 0) -> Column:
    """The id of output ``index`` that the stage ``name`` makes of the message ``parent``."""
    return _digest(F.unhex(parent), _named(F.lit(name)), _number(F.lit(index) if isinstance(index, int) else index, 4))


def stage_id(client: Column, stage: str, name: Column) -> Column:
    """The id of a result of a client's whole input, such as a group's aggregate."""
    return _digest(_named(client), _named(F.lit(stage)), _named(name))
