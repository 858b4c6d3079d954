"""Spark jobs of several calls at once: small jobs do not fill a cluster one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import SparkContext, inheritable_thread_target


def side_by_side[T, R](function: Callable[[T], R], items: Iterable[T], n_jobs: int = 8) -> list[R | Exception]:
    """The calls' results in the order of the items; a call that raises gives its exception.

    At most n_jobs calls run at a time. Each has a scheduler pool of its own, so that with
    spark.scheduler.mode FAIR they share the cores evenly.
    """

    def call(numbered: tuple[int, T]) -> R | Exception:
        SparkContext.getOrCreate().setLocalProperty("spark.scheduler.pool", f"side-{numbered[0] % n_jobs}")
        try:
            return function(numbered[1])
        except Exception as e:  # the caller counts them
            return e

    with ThreadPoolExecutor(max_workers=max(1, n_jobs)) as pool:
        return list(pool.map(inheritable_thread_target(call), enumerate(items)))
