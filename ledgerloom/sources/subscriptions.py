"""Subscriptions of a network from the service that keeps them, over HTTP."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request


class SubscriptionsUnavailable(RuntimeError):
    pass


def fetch(base_url: str, network: str, status: str = "ACTIVE", timeout: float = 30) -> list[dict]:
    """The service's records; an answer that isn't 2xx or isn't a list is an error."""
    url = f"{base_url.rstrip('/')}/subscriptions?{urllib.parse.urlencode({'network': network, 'status': status})}"
    try:
        with urllib.request.urlopen(url, timeout=timeout) as response:
            rows = json.loads(response.read())
    except (urllib.error.URLError, ValueError) as error:
        raise SubscriptionsUnavailable(f"{url}: {error}") from error
    if not isinstance(rows, list):
        raise SubscriptionsUnavailable(f"{url}: not a list")
    return rows


def contracts(rows: list[dict]) -> dict[str, int | None]:
    """Addresses (lower-case, each once) with the least start block that is given for them."""
    out: dict[str, int | None] = {}
    for r in rows:
        address, start = r["address"].lower(), r.get("startBlock")
        known = out.get(address)
        out[address] = start if known is None else known if start is None else min(known, start)
    return out
