"""In-process subscriptions, and a listener that publishes a stream's progress."""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)


class Broker:
    """Handlers by topic, called in the order they came; one that fails stops no other."""

    def __init__(self):
        self._handlers: dict[str, dict[int, Callable]] = defaultdict(dict)
        self._next = 0

    def subscribe(self, topic: str, handler: Callable) -> Callable[[], None]:
        """Adds a handler; the result removes it."""
        self._next += 1
        key = self._next
        self._handlers[topic][key] = handler
        return lambda: self._handlers[topic].pop(key, None)

    def publish(self, topic: str, event) -> int:
        """Calls the topic's handlers; returns how many did not fail."""
        good = 0
        for handler in list(self._handlers[topic].values()):
            try:
                handler(event)
                good += 1
            except Exception:  # noqa: BLE001  a subscriber's fault is its own
                log.exception("handler of %s", topic)
        return good


class Progress(StreamingQueryListener):
    """Publishes ``started``, ``progress`` and ``ended`` of streaming queries."""

    def __init__(self, broker: Broker):
        self.broker = broker

    def onQueryStarted(self, event) -> None:
        self.broker.publish("started", str(event.id))

    def onQueryProgress(self, event) -> None:
        self.broker.publish("progress", event.progress.json)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.broker.publish("ended", str(event.id))
