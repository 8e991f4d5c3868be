"""Paced, patient HTTP on the driver; what comes back is written as tables, executors never call out."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Iterator

#: Too many requests, and servers that shed load.
RETRIED = (429, 500, 502, 503, 504)
RETRIES, FLOOR_S, CEILING_S, STOP_AFTER, BATCH = 5, 15.0, 300.0, 5, 500


def backoff(floor: float, attempt: int, jitter: Callable[[], float] = random.random) -> float:
    """Doubles with each attempt, a quarter less to a quarter more at random, up to a ceiling."""
    return min(CEILING_S, floor * 2**attempt * (0.75 + jitter() / 2))


def chunks(items: list, size: int = BATCH) -> Iterator[list]:
    for k in range(0, len(items), size):
        yield items[k : k + size]


def get_with_retry(session, url: str, params: dict | None = None, *, retries: int = RETRIES, floor: float = FLOOR_S, timeout: float = 30, headers: dict | None = None, sleep: Callable[[float], None] = time.sleep):
    """GET again after RETRIED and dropped connections; a server's Retry-After counts up to the ceiling. Other errors raise at once."""
    last: Exception | None = None
    for attempt in range(retries):
        try:
            response = session.get(url, params=params, timeout=timeout, **({"headers": headers} if headers else {}))
        except (ConnectionError, TimeoutError, OSError) as e:
            last = e
            sleep(backoff(floor, attempt))
            continue
        if response.status_code in RETRIED:
            asked = str(response.headers.get("Retry-After", ""))
            sleep(min(CEILING_S, float(asked)) if asked.isdigit() else backoff(floor, attempt))
            last = RuntimeError(f"status {response.status_code}")
            continue
        response.raise_for_status()
        return response
    raise RuntimeError(f"gave up after {retries} attempts") from last


def fetch_all(keys: Iterable[str], fetch: Callable[[str], object], *, cached: Iterable[dict] = (), delay: float = 3.0, on_result: Callable | None = None, on_error: Callable | None = None, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Each key from the first cache that has it, else live with a pause; stops after five failures in a row."""
    out, failed = {}, 0
    for key in keys:
        held = next((c[key] for c in cached if key in c), None)
        if held is not None:
            out[key] = held
            continue
        try:
            out[key] = fetch(key)
            failed = 0
            if on_result:
                on_result(key, out[key])
        except Exception as e:  # noqa: BLE001 - the caller decides what a failure means
            failed += 1
            if on_error:
                on_error(key, e)
            if failed >= STOP_AFTER:
                break
        sleep(delay)
    return out


def first_mirror(path: str, mirrors: Iterable[str], get: Callable[[str], object]) -> object:
    """The first mirror that answers; the last one's error if none does."""
    last: Exception | None = None
    for base in mirrors:
        try:
            return get(f"{base}/{path}")
        except Exception as e:  # noqa: BLE001
            last = e
    raise RuntimeError("no mirror answered") from last


def abstracts_by_doi(dois: list[str], post: Callable[[list[str]], list[dict | None]]) -> dict[str, str | None]:
    """Abstracts in batches; an answer that names another work counts as not found."""
    out: dict[str, str | None] = {}
    for part in chunks(dois):
        for doi, answer in zip(part, post(part)):
            said = ((answer or {}).get("externalIds") or {}).get("DOI", "").lower()
            out[doi] = (answer or {}).get("abstract") if said == doi.lower() else None
    return out
