"""Answers that are asked for again: computed once while they are being computed, and kept for a time."""

from __future__ import annotations

import time
from collections.abc import Callable, Hashable
from concurrent.futures import Future
from threading import Lock

from pyspark.sql import DataFrame


class Answers:
    """Small results by question.  All who ask while a question is being answered share one computation; an answer is
    given again until it is `seconds` old; one that failed isn't kept.  Answers that are too old, whoever asked, go when the
    next one is asked for, so what is kept is what was asked within `seconds`.  Only for bounded results, such as dashboards'."""

    def __init__(self, seconds: float, now: Callable[[], float] = time.monotonic):
        self.seconds, self.now, self.computed = seconds, now, 0
        self.lock, self.kept, self.waiting = Lock(), {}, {}

    def _drop(self, of: Callable[[float], bool]) -> None:
        """With the lock held."""
        for question in [q for q, (at, _) in self.kept.items() if of(at)]:
            self.kept.pop(question)[1].unpersist()

    def ask(self, question: Hashable, answer: Callable[[], DataFrame]) -> DataFrame:
        with self.lock:
            self._drop(lambda at: self.now() - at >= self.seconds)
            if question in self.kept:
                return self.kept[question][1]
            first = question not in self.waiting
            mine = self.waiting.setdefault(question, Future())
        if not first:
            return mine.result()
        try:
            df = answer().persist()
            df.count()
        except BaseException as e:
            with self.lock:
                del self.waiting[question]
            mine.set_exception(e)
            raise
        with self.lock:
            self.computed += 1
            self.kept[question] = (self.now(), df)
            del self.waiting[question]
        mine.set_result(df)
        return df

    def forget(self) -> None:
        """Lets go of what is kept; what is being answered is kept again when it is done."""
        with self.lock:
            self._drop(lambda at: True)
