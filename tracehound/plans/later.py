"""Columns that are written down when a module is read, before there is a session, and made when a query runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Later:
    def __init__(self, make: Callable[[], Column]):
        self.make = make

    def cast(self, kind: str) -> Later:
        return Later(lambda: self.make().cast(kind))

    def __mod__(self, n) -> Later:
        return Later(lambda: self.make() % made(n))

    def __mul__(self, n) -> Later:
        return Later(lambda: self.make() * made(n))

    def __add__(self, n) -> Later:
        return Later(lambda: self.make() + made(n))

    def __truediv__(self, n) -> Later:
        return Later(lambda: self.make() / made(n))


def made(x):
    return x.make() if isinstance(x, Later) else x


class _Functions:
    """The names of pyspark.sql.functions."""

    def __getattr__(self, name: str):
        return lambda *args: Later(lambda: getattr(F, name)(*map(made, args)))


E = _Functions()
