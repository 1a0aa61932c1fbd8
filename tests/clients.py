"""Stand-ins for embedding services."""

import os
import time
import uuid

import numpy as np


class Flaky:
    """Fails in the ways a service can; says which endpoint was called."""

    def __init__(self):
        self.calls = 0

    def __call__(self, texts, endpoint):
        self.calls += 1
        if any(t == "always" for t in texts):
            raise RuntimeError("down")
        if any(t == "lost" for t in texts):
            raise ConnectionError("lost")
        if any(t == "nothing" for t in texts):
            return None
        if any(t == "short" for t in texts):
            return []
        if any(t == "once" for t in texts) and self.calls == 1:
            raise ConnectionError("try again")
        return [[1, 2] if t == "ints" else None if t == "bad" else [float(len(t)), float(endpoint or 0)] for t in texts]


LOADS = []


def load_lengths():
    LOADS.append(1)

    def model(texts, role):
        assert texts and len(texts) <= 3
        return np.array([[len(t), role == "query", len(LOADS)] for t in texts], dtype=float)

    return model


class Logging:
    """A factory whose clients leave a file for each call, named by the number
    of texts and the first one, with its beginning and end."""

    def __init__(self, folder, seconds=0.0, stop=None, kill=None):
        self.folder, self.seconds, self.stop, self.kill = folder, seconds, stop, kill

    def __call__(self):
        return self.ask

    def ask(self, texts, endpoint):
        began = time.time()
        time.sleep(self.seconds)
        name = f"{self.folder}/{len(texts)}-{texts[0]}-{uuid.uuid4().hex}"
        if self.stop in texts:
            raise SystemExit("stopped")
        mark = f"{self.folder}.killed"
        with open(name, "w") as f:
            f.write(f"{began} {time.time()}")
        if self.kill in texts and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)
        return [[1.0, float(len(t))] for t in texts]


class Widths:
    """As many components as a text has characters."""

    def __call__(self, texts, endpoint):
        return [[1.0] * len(t) for t in texts]
