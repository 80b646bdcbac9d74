"""Backoff and rate limits of JSON-RPC nodes."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable


class RpcError(RuntimeError):
    pass


class RateLimited(RpcError):
    pass


class RetriesExhausted(RpcError):
    def __init__(self, start: int | None, end: int | None, attempts: int, cause: Exception):
        super().__init__(f"gave up after {attempts} attempts on blocks {start}..{end}: {cause}")
        self.start, self.end = start, end


def backoff_ms(attempt: int, initial: int = 200, most: int = 10_000) -> int:
    """The wait before retry `attempt`, counted from 0."""
    return min(initial * 2 ** max(attempt, 0), most)


def reconnect_ms(attempt: int, initial: int = 500, most: int = 30_000) -> int:
    """The wait before reconnect `attempt`, counted from 1."""
    if attempt < 1:
        raise ValueError("attempts count from 1")
    return min(initial * 2 ** (attempt - 1), most)


def is_rate_limit(status: int | None, code: int | None, message: str | None) -> bool:
    text = (message or "").lower()
    return status == 429 or code == -32005 or "rate limit" in text or "too many request" in text


class RpcClient:
    """JSON-RPC over HTTP with retries on rate limits; other errors are raised at once."""

    def __init__(self, url: str, retries: int = 5, initial_ms: int = 200, most_ms: int = 10_000, sleep: Callable[[float], None] = time.sleep, timeout: float = 30):
        self.url, self.retries, self.initial_ms, self.most_ms, self.sleep, self.timeout = url, retries, initial_ms, most_ms, sleep, timeout

    def _once(self, method: str, params: list):
        body = json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as response:
                answer = json.loads(response.read())
        except urllib.error.HTTPError as error:
            text = error.read().decode("utf-8", "replace")
            raise (RateLimited if is_rate_limit(error.code, None, text) else RpcError)(f"HTTP {error.code}: {text[:200]}") from error
        if answer.get("error"):
            e = answer["error"]
            raise (RateLimited if is_rate_limit(None, e.get("code"), e.get("message")) else RpcError)(f"{e.get('code')}: {e.get('message')}")
        return answer.get("result")

    def call(self, method: str, params: list, span: tuple[int | None, int | None] = (None, None)):
        for attempt in range(self.retries + 1):
            try:
                return self._once(method, params)
            except RateLimited as error:
                if attempt == self.retries:
                    raise RetriesExhausted(*span, attempt + 1, error) from error
                self.sleep(backoff_ms(attempt, self.initial_ms, self.most_ms) / 1000)

    def block_number(self) -> int:
        return hex_long(self.call("eth_blockNumber", []))

    def logs(self, start: int, end: int, addresses: list[str]) -> list[dict]:
        if not addresses:
            return []
        return self.call("eth_getLogs", [{"fromBlock": hex(start), "toBlock": hex(end), "address": addresses}], (start, end)) or []


def hex_long(text: str) -> int:
    digits = text.removeprefix("0x")
    return int(digits, 16) if digits else 0
