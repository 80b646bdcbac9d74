"""A WebSocket client of the standard library: text frames of a log subscription."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import socket
import ssl
import struct
from collections.abc import Iterator
from urllib.parse import urlsplit

#: Fixed value of the protocol: what the accept header is made with.
GUID = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
TEXT, BINARY, CLOSE, PING, PONG = 1, 2, 8, 9, 10


class Closed(ConnectionError):
    pass


class WebSocket:
    def __init__(self, url: str, timeout: float = 30, idle: float = 1.0):
        at = urlsplit(url)
        secure = at.scheme == "wss"
        raw = socket.create_connection((at.hostname, at.port or (443 if secure else 80)), timeout)
        self.sock = ssl.create_default_context().wrap_socket(raw, server_hostname=at.hostname) if secure else raw
        self.held = b""
        key = base64.b64encode(os.urandom(16)).decode()
        path = (at.path or "/") + (f"?{at.query}" if at.query else "")
        self.sock.sendall(f"GET {path} HTTP/1.1\r\nHost: {at.netloc}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
        while b"\r\n\r\n" not in self.held:
            self._more()
        head, self.held = self.held.split(b"\r\n\r\n", 1)
        lines = head.decode("latin-1").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        if " 101 " not in f"{lines[0]} " or headers.get("sec-websocket-accept") != base64.b64encode(hashlib.sha1((key + GUID).encode()).digest()).decode():
            self.sock.close()
            raise Closed(f"no WebSocket at {url}: {lines[0]}")
        self.sock.settimeout(idle)

    def _more(self) -> None:
        part = self.sock.recv(65536)
        if not part:
            raise Closed("the connection ended")
        self.held += part

    def _frame(self) -> tuple[bool, int, bytes] | None:
        """(last, kind, body) of a frame that has arrived whole, or None."""
        if len(self.held) < 2:
            return None
        first, second = self.held[:2]
        size, at = second & 127, 2
        if size > 125:
            width = 2 if size == 126 else 8
            if len(self.held) < at + width:
                return None
            size, at = struct.unpack(">H" if width == 2 else ">Q", self.held[at : at + width])[0], at + width
        mask = 4 if second & 128 else 0
        if len(self.held) < at + mask + size:
            return None
        body = self.held[at + mask : at + mask + size]
        if mask:
            body = bytes(b ^ self.held[at + i % 4] for i, b in enumerate(body))
        self.held = self.held[at + mask + size :]
        return bool(first & 128), first & 15, body

    def send(self, body: bytes, kind: int = TEXT) -> None:
        """One frame, masked as a client's must be."""
        size, mask = len(body), os.urandom(4)
        head = struct.pack(">BB", 128 | kind, 128 | size) if size < 126 else struct.pack(">BBH", 128 | kind, 254, size) if size < 65536 else struct.pack(">BBQ", 128 | kind, 255, size)
        self.sock.sendall(head + mask + bytes(b ^ mask[i % 4] for i, b in enumerate(body)))

    def messages(self) -> Iterator[str | None]:
        """Text messages as they come, and None whenever none has come for a while; ends with the connection."""
        parts: list[bytes] = []
        while True:
            frame = self._frame()
            if frame is None:
                try:
                    self._more()
                except TimeoutError:
                    yield None
                except (Closed, OSError):
                    return
                continue
            last, kind, body = frame
            if kind == CLOSE:
                return
            if kind == PING:
                self.send(body, PONG)
            elif kind != PONG:
                parts.append(body)
                if last:
                    yield b"".join(parts).decode("utf-8", "replace")
                    parts = []

    def close(self) -> None:
        try:
            self.send(struct.pack(">H", 1000), CLOSE)
        except OSError:
            pass
        self.sock.close()


def log_frames(url: str, idle: float = 1.0):
    """`connect` of the push source: subscribes to the logs of addresses and yields frames."""

    def connect(addresses: list[str]) -> Iterator[str | None]:
        ws = WebSocket(url, idle=idle)
        try:
            ws.send(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "eth_subscribe", "params": ["logs", {"address": addresses}]}).encode())
            yield from ws.messages()
        finally:
            ws.close()

    return connect
