"""A local service of pages for the tests: p0 to p29, each naming the next; calls go to the file that PAGE_LOG names."""

import json
import os


def _log():
    return os.environ.get("PAGE_LOG", os.devnull)  # Spark's workers don't have the test's


def make():
    def reply(requests):
        with open(_log(), "a") as f:
            f.writelines(r + "\n" for r in requests)
        out = []
        for r in requests:
            n = int(r[1:])
            if n == 25 and os.path.exists(_log() + ".down"):
                raise OSError("down")
            out.append(json.dumps({"entities": [{"name": f"e{n}", "href": f"/{n}"}]} | ({"next": f"p{n + 1}"} if n < 29 else {})))
        return out

    return reply


def encoder():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


def judge():
    return lambda requests: ["<answer>yes</answer>" for _ in requests]


def failing():
    def reply(requests):
        raise RuntimeError("killed")

    return reply
