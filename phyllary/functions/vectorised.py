"""Vectorised Python functions that need no session where they are defined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from phyllary.session import arrow_function


def vectorised(return_type: str) -> Callable:
    """A function of pandas series as a function of columns; the Arrow UDF is made when it is called, with the session at hand."""

    def wrap(f: Callable) -> Callable:
        def call(*columns: Column | str) -> Column:
            return arrow_function(f, return_type)(*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap
