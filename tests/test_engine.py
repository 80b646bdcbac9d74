"""Interfaces, decoding, the lifecycle in batch and streaming, sources, sinks, and every query against its SQL."""

import json
import random
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import oracle
import pytest
from pyspark.sql import functions as F

from ledgerloom.abi.decoder import decode_log
from ledgerloom.abi.keccak import topic0
from ledgerloom.abi.registry import AbiRegistry
from ledgerloom.abi.types import AbiError, parse_abi, parse_type
from ledgerloom.config import NetworkParams, UnknownNetwork, load_config, params_for
from ledgerloom.engine import Engine, state_of
from ledgerloom.lifecycle.batch import fold_in_order, lifecycle_batch
from ledgerloom.lifecycle.core import Event, NetworkState, Options, Raw, confirmations_seen, same_fields, step, track_block
from ledgerloom.model import RAW_LOG
from ledgerloom.operators import blocks
from ledgerloom.operators.ranges import catchup, plan, resolve_start
from ledgerloom.plans import catalog
from ledgerloom.sources import retry, rpc
from ledgerloom.sources.push import PushIngestion, frame_kind
from ledgerloom.streaming.lifecycle import lifecycle_stream

REG = AbiRegistry().all()
TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
P12 = NetworkParams(12, 3)


def word(n):
    return f"{n % (1 << 256):064x}"


def test_topic0_vectors():
    assert topic0("Transfer(address,address,uint256)") == TRANSFER
    assert topic0("Approval(address,address,uint256)") == "0x8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925"
    assert next(iter(REG["nested-orders"])) == "0x883a29c585a711196682f83262b3d548f4780b7a4c3d82b9400aac59a901af79"


def test_decode_vectors():
    topics = [TRANSFER, "0x" + word(0xDE), "0x" + word(0xBE)]
    for value in (2**256 - 1, 1, 100):
        name, signature, fields, error = decode_log(topics, "0x" + word(value), "erc20", REG)
        assert (name, signature, error) == ("Transfer", TRANSFER, None)
        assert json.loads(fields) == {"from": f"0x{0xDE:040x}", "to": f"0x{0xBE:040x}", "value": str(value)}
    event = next(iter(REG["nested-orders"].values()))
    head = word(7) + word(0xAB) + word(-5) + word(1) + word(192) + word(320)
    data = "0x" + head + word(3) + word(1) + word(2) + word(10) + word(5) + b"hello".hex().ljust(64, "0")
    fields = json.loads(decode_log([event.topic0, "0x" + word(0xFF)], data, "nested-orders", REG)[2])
    assert fields == {"maker": f"0x{0xFF:040x}", "order": {"id": "7", "asset": {"token": f"0x{0xAB:040x}", "delta": "-5"}, "active": True}, "amounts": ["1", "2", "10"], "memo": "hello"}


@pytest.mark.parametrize(("topics", "data", "ref", "reason"), [([TRANSFER, "0x" + word(1)], "0x", "erc20", "topic count mismatch for Transfer: expected 2 indexed topic(s), got 1"), ([TRANSFER], "0x", "does-not-exist", "decode error: unknown abiRef"), (["0xabab"], "0x", "erc20", "no event in abiRef 'erc20' matches topic0 0xabab"), ([], "0x", "erc20", "log has no topics (anonymous events unsupported)"), (None, None, "erc20", "log has no topics"), ([TRANSFER, "0x" + word(1), "0x" + word(2)], "0x123", "erc20", "decode error: bad hex"), ([TRANSFER, "0x01", "0x" + word(2)], "0x" + word(1), "erc20", "decode error: topic has 1 bytes"), ([TRANSFER, "0x" + word(1), "0x" + word(2)], None, "erc20", "decode error: needs 32 bytes")])
def test_dead_letter_reasons(topics, data, ref, reason):
    assert decode_log(topics, data, ref, REG)[3].startswith(reason)


def test_hostile_lengths_end_as_dead_letters():
    event = next(iter(REG["nested-orders"].values()))
    data = "0x" + word(7) + word(0) + word(0) + word(1) + word(192) + word(192) + word(2**31 - 1)
    assert "exceeds" in decode_log([event.topic0, "0x" + word(1)], data, "nested-orders", REG)[3]


@pytest.mark.parametrize("text", ["{", "{}", "[]", '[{"type":"function"}]', '[{"type":"event"}]', '[{"type":"event","name":"A","inputs":[{"name":"x"}]}]', '[{"type":"event","name":"A","inputs":[{"name":"x","type":"tuple"}]}]', '[{"type":"event","name":"A","inputs":[{"name":"x","type":"bytes33"}]}]', '[{"type":"event","name":"A","inputs":[{"name":"x","type":"tuple","components":[{"name":"y"}]}]}]'])
def test_bad_interfaces(text):
    with pytest.raises(AbiError):
        parse_abi(text)


def test_types():
    t = parse_type("tuple[2][]", [{"name": "a", "type": "uint"}, {"name": "b", "type": "bytes4"}])
    assert (t.canonical, t.dynamic, t.members[0][1].head) == ("(uint256,bytes4)[2][]", True, 128)
    assert parse_type("int8[3]").spark() == "array<string>"


def ev(block, source="WS", value="100"):
    return Event("Transfer", TRANSFER, "0xc", block, source, json.dumps({"value": value, "from": "a"}))


def run(rows, params=P12, options=Options()):
    state, out = NetworkState(), []
    for r in rows:
        out += step(state, r, params, options)
    return state, out


def raw(block, event=None, tx="0x1", hash_=None):
    return Raw(tx, 0, block, hash_ or f"h{block}", 1000 + block, event)


def test_lifecycle_vectors():
    state, out = run([raw(100, ev(100)), raw(100, ev(100, "POLL"))])
    assert not out and not state.sightings and state.confirmations[("0x1", 0)].status == "UNCONFIRMED"
    for source, kind in (("POLL", "WS_GAP_SUSPECTED"), ("WS", "POLL_ONLY_CONFIRMED")):
        state, out = run([raw(100, ev(100, source)), *(raw(b, tx="x") for b in (101, 102, 103, 104))])
        assert [o.anomaly for o in out] == [kind] and not state.sightings
    rows = [raw(100, ev(100)), raw(100, ev(100, "POLL")), *(raw(b, tx="x") for b in range(101, 112))]
    assert run(rows)[1] == []
    state, out = run([*rows, raw(112, tx="x")])
    assert [(o.status, o.confirmations_seen) for o in out] == [("CONFIRMED", 12)]
    state, out = run([*rows, *(raw(b, tx="x") for b in range(112, 141))])
    assert len(out) == 1 and not state.confirmations
    state, out = run([raw(100, tx="x"), raw(101, ev(101)), raw(102, tx="y"), raw(101, tx="z", hash_="other")])
    assert [o.status for o in out] == ["INVALIDATED"] and state.last == 101 and state.ancestry == {100: "h100", 101: "other"}
    confirmed = [raw(100, ev(100)), raw(100, ev(100, "POLL")), *(raw(b, tx="x") for b in range(101, 113)), raw(100, tx="z", hash_="other")]
    assert [o.status for o in run(confirmed)[1] if o.status] == ["CONFIRMED"]  # what is confirmed stays so
    _, out = run([raw(100, ev(100)), raw(100, ev(100, "POLL", "999"))])
    assert [o.anomaly for o in out] == ["DIVERGENT_DECODE"]


def test_lifecycle_choices():
    chain = [raw(100, tx="x"), raw(101, ev(101)), raw(102, ev(102), "0x2"), raw(101, tx="z", hash_="other")]
    assert len(run(chain)[1]) == 1 and len(run(chain, options=Options(invalidate_descendants=True))[1]) == 2
    rows = [raw(100, ev(100)), *(raw(b, tx="x") for b in range(101, 115))]
    status = lambda o: [x.status for x in o if x.status]
    assert status(run(rows)[1]) == ["CONFIRMED"] and status(run(rows, options=Options(require_poll=True))[1]) == []
    late = [*rows, raw(100, ev(100, "POLL"))]
    assert status(run(late)[1]) == ["CONFIRMED"]


def test_ancestry_is_bounded_and_distance_clamped():
    state = NetworkState()
    for n in range(1, 501):
        track_block(state, n, f"h{n}", 12)
    assert 12 <= len(state.ancestry) < 100 and state.last == 500
    assert track_block(state, 500, "h500", 12) is None and confirmations_seen(95, 100) == 0 and confirmations_seen(2**40, 0) == 2**31 - 1
    assert same_fields('{"a":1,"b":2}', '{"b":2,"a":1}') and not same_fields('{"a":1}', '{"a":2}')


def test_planner_and_backoff():
    assert plan(0, 120, 50) == [(0, 49), (50, 99), (100, 120)] and plan(5, 4, 10) == []
    with pytest.raises(ValueError):
        plan(0, 1, 0)
    assert (resolve_start(9, 1, 5), resolve_start(None, 1, 5), resolve_start(None, None, 5)) == (10, 1, 5)
    assert (catchup(100, 103), catchup(None, 103), catchup(103, 103)) == ((101, 103), None, None)
    assert [retry.backoff_ms(i) for i in (0, 1, 5, 6, 99)] == [200, 400, 6400, 10000, 10000]
    assert [retry.reconnect_ms(i) for i in (1, 2, 7)] == [500, 1000, 30000]
    assert frame_kind('{"method":"x"}') == "NOTIFICATION" and frame_kind('{"id":1}') == "ACK"


def test_config():
    c = load_config(env={"MAX_RETRIES": "7", "POLL_INTERVAL_MS": " ", "RPC_URL_BASE": "http://x"})
    assert (c.max_retries, c.poll_interval_ms, c.rpc_urls) == (7, 15000, {"base": "http://x"})
    with pytest.raises(UnknownNetwork):
        params_for({}, "nowhere")


class Node(BaseHTTPRequestHandler):
    head, limited, calls = 103, 0, []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Node.calls.append(body)
        if Node.limited:
            Node.limited -= 1
            answer = {"error": {"code": -32005, "message": "rate limit"}}
        elif body["method"] == "eth_blockNumber":
            answer = {"result": hex(Node.head)}
        else:
            p = body["params"][0]
            span = range(int(p["fromBlock"], 16), int(p["toBlock"], 16) + 1)
            answer = {"result": [{"address": p["address"][0], "blockHash": f"0xb{b}", "blockNumber": hex(b), "data": "0x", "logIndex": "0x0", "topics": [TRANSFER], "transactionHash": f"0xt{b}"} for b in span if b % 10 == 1]}
        data = json.dumps(answer).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def node():
    server = HTTPServer(("127.0.0.1", 0), Node)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_rpc_source(spark, node, tmp_path):
    rpc.register(spark)
    reader = lambda r: r.format("evm_rpc").option("network", "base").option("url", node).option("addresses", "0xA").option("startBlocks", '{"0xa": 0}').option("maxBlockRange", "50")
    assert sorted(r.block_number for r in reader(spark.read).load().collect()) == list(range(1, 103, 10))
    go = lambda: reader(spark.readStream).load().writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start().awaitTermination()
    go()
    Node.head = 125
    go()
    Node.head = 103
    assert sorted(r.block_number for r in spark.read.parquet(str(tmp_path / "o")).collect()) == list(range(1, 125, 10))


def test_retries(node):
    waits = []
    client = retry.RpcClient(node, retries=2, sleep=waits.append)
    Node.limited = 2
    assert client.block_number() == 103 and waits == [0.2, 0.4]
    Node.limited = 3
    with pytest.raises(retry.RetriesExhausted, match="7..9"):
        client.logs(7, 9, ["0xa"])
    Node.limited = 0
    assert client.logs(1, 2, []) == []


def test_push_catch_up(node):
    log = lambda b: json.dumps({"method": "eth_subscription", "params": {"result": {"address": "0xa", "blockHash": "h", "blockNumber": hex(b), "logIndex": "0x0", "transactionHash": f"0x{b}"}}})
    frames, got = iter([['{"id":1,"result":"0x1"}', log(100)], [log(104)]]), []
    push = PushIngestion("base", retry.RpcClient(node), lambda a: next(frames), lambda: ["0xa", "0xa"], got.extend, sleep=lambda s: None)
    push.last_seen = 100
    push.run(2)
    assert [(r[4], r[8]) for r in got] == [(100, "WS"), (101, "WS"), (104, "WS")] and push.last_seen == 104
    assert got[0][10] < got[1][10] < got[2][10]


def test_push_connects_anew_when_addresses_change(node):
    seen, now, lists = [], iter(range(0, 10**6, 3000)), [["0xa"]] * 4 + [["0xa", "0xb"]] * 99
    watched = iter(lists)

    def connect(addresses):
        seen.append(addresses)
        yield from [None] * 20

    push = PushIngestion("base", retry.RpcClient(node), connect, lambda: next(watched), lambda rows: None, sleep=lambda s: seen.append(s), clock=lambda: next(now))
    push.run(2)
    assert seen == [["0xa"], ["0xa", "0xb"]]  # at once, without a wait


def test_arrivals_differ_by_time_and_source():
    log = {"address": "0xa", "blockHash": "h", "blockNumber": "0x10", "logIndex": "0x1", "transactionHash": "0x1"}
    ws, poll, again = (rpc.Arrivals(s, n, lambda: 1_700_000_000_000) for s, n in (("WS", 0), ("POLL", 1), ("POLL", 2)))
    rows = [rpc.to_row(log, "base", "WS", 1, a.next()) for a in (ws, poll, again, ws, ws)]
    assert len({r[10] for r in rows}) == 5 and rows[0][10] < rows[3][10] < rows[4][10] < 2**63
    assert rpc.Arrivals("WS", 0, lambda: 1_700_000_000_100).next() > rows[4][10] and rpc.Arrivals("POLL", 1023, lambda: 8_000_000_000_000).next() < 2**63


def websocket_server(frames):
    """Accepts one client, reads its subscription, and sends the frames; what it read."""
    import base64
    import hashlib
    import socket

    from ledgerloom.sources.websocket import GUID

    listener, got = socket.create_server(("127.0.0.1", 0)), []

    def run():
        peer, _ = listener.accept()
        data = b""
        while b"\r\n\r\n" not in data:
            data += peer.recv(4096)
        key = next(x.split(b": ")[1] for x in data.split(b"\r\n") if x.lower().startswith(b"sec-websocket-key"))
        accept = base64.b64encode(hashlib.sha1(key + GUID.encode()).digest())
        peer.sendall(b"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: " + accept + b"\r\n\r\n")
        head = peer.recv(2)
        n = head[1] & 127
        n = int.from_bytes(peer.recv(2)) if n == 126 else n
        mask, body = peer.recv(4), b""
        while len(body) < n:
            body += peer.recv(n - len(body))
        got.append(bytes(b ^ mask[i % 4] for i, b in enumerate(body)).decode())
        for frame in frames:
            peer.sendall(frame)
        peer.close()

    threading.Thread(target=run, daemon=True).start()
    return f"ws://127.0.0.1:{listener.getsockname()[1]}/", got


def test_websocket_transport(node):
    from ledgerloom.sources.websocket import log_frames

    note = json.dumps({"method": "eth_subscription", "params": {"result": {"address": "0xa", "blockHash": "h", "blockNumber": "0x68", "logIndex": "0x0", "transactionHash": "0x1", "data": "0x" + "ab" * 40_000}}}).encode()
    ack = b'{"id":1,"result":"0x1"}'
    frames = [bytes([129, len(ack)]) + ack, bytes([137, 2]) + b"hi", bytes([1, 126]) + (1000).to_bytes(2) + note[:1000], bytes([128, 127]) + (len(note) - 1000).to_bytes(8) + note[1000:], bytes([136, 0])]
    url, got = websocket_server(frames)
    rows = []
    push = PushIngestion("base", retry.RpcClient(node), log_frames(url), lambda: ["0xa"], rows.extend, sleep=lambda s: None)
    push.run(1)
    assert json.loads(got[0])["params"] == ["logs", {"address": ["0xa"]}] and [(r[4], len(r[7])) for r in rows] == [(104, 80_002)]


def test_subscription_service_and_endpoints(spark):
    from http.server import ThreadingHTTPServer
    from types import SimpleNamespace
    from urllib.error import HTTPError
    from urllib.request import urlopen

    from ledgerloom.sources import subscriptions
    from ledgerloom.streaming.endpoint import serve
    from ledgerloom.streaming.metrics import Metrics

    class Service(Node):
        def do_GET(self):
            ok = "network=base" in self.path and "status=ACTIVE" in self.path
            data = json.dumps([{"address": "0xA", "startBlock": 7}, {"address": "0xa", "startBlock": 5}, {"address": "0xb"}]).encode()
            self.send_response(200 if ok else 500)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert subscriptions.contracts(subscriptions.fetch(url, "base")) == {"0xa": 5, "0xb": None}
    with pytest.raises(subscriptions.SubscriptionsUnavailable):
        subscriptions.fetch(url, "polygon")
    server.shutdown()
    metrics = Metrics()
    metrics.onQueryStarted(SimpleNamespace(runId="r", name="q", id="i"))
    metrics.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(name="q", id="i", numInputRows=5)))
    server = serve(metrics)
    url = f"http://127.0.0.1:{server.server_port}"
    assert b'input_rows_total{query="q"} 5' in urlopen(f"{url}/metrics").read() and urlopen(f"{url}/health").status == 200
    metrics.onQueryTerminated(SimpleNamespace(runId="r", id="i", exception="boom"))
    for path, code in (("health", 503), ("else", 404)):
        with pytest.raises(HTTPError) as error:
            urlopen(f"{url}/{path}")
        assert error.value.code == code
    server.shutdown()


def test_strict_records_and_settings(spark, tmp_path):
    from ledgerloom.config import load_file
    from ledgerloom.model import integer_of_text, parsed_strictly, split_malformed

    texts = ['{"network":"base","last_block":5,"more":1}', '{"network":"base"}', "{", '{"network":"base","last_block":"x"}', "[]"]
    good, bad = parsed_strictly(spark.createDataFrame([(t,) for t in texts], "value string"), "network string, last_block bigint", ["network", "last_block"])
    assert [tuple(r) for r in good.collect()] == [("base", 5)] and sorted(r.value for r in bad.collect()) == sorted(texts[1:])
    assert "missing: last_block" in {r.reason for r in bad.collect()}
    assert integer_of_text("-12") == -12
    for value in (12, 1.5, "1e3", "", None):
        with pytest.raises(ValueError):
            integer_of_text(value)
    rows = [("base", "0xa", "0x1", 0, 1, "h", [], "0x", source, 1, 1) for source in ("WS", "OTHER", None)]
    kept, odd = split_malformed(spark.createDataFrame(rows, RAW_LOG))
    assert (kept.count(), odd.count()) == (1, 2)
    (tmp_path / "a.toml").write_text('max_retries = 9\n[rpc_urls]\nbase = "http://y"\n[networks.testnet]\nconfirmation_depth = 2\n')
    settings, networks = load_file(str(tmp_path / "a.toml"), env={"RPC_URL_POLYGON": "http://p", "MAX_BLOCK_RANGE": "9"})
    assert (settings.max_retries, settings.max_block_range, settings.rpc_urls, networks) == (9, 9, {"base": "http://y", "polygon": "http://p"}, {"testnet": NetworkParams(2)})
    with pytest.raises(TypeError):
        (tmp_path / "b.json").write_text('{"odd": 1}')
        load_file(str(tmp_path / "b.json"))


def test_database_table():
    import sqlite3

    from ledgerloom.sinks.confirmed import COLUMNS, migrate, upsert_sql

    db = sqlite3.connect(":memory:")
    for _ in range(2):
        migrate(db, json_type="TEXT", gin=False)
    row = dict(zip(COLUMNS, ["Transfer", "s", "base", "0xc", "0x1", 0, 5, "CONFIRMED", "WS", "{}"], strict=True))
    for status in ("CONFIRMED", "INVALIDATED", "INVALIDATED"):
        db.execute(upsert_sql("?"), [{**row, "status": status}[c] for c in COLUMNS])
    assert db.execute("select status, count(*), max(updated_at) is not null from confirmed_events").fetchall() == [("INVALIDATED", 1, 1)]
    assert {r[0] for r in db.execute("select name from sqlite_master where type = 'index' and sql is not null")} == {"confirmed_events_block", "confirmed_events_status"}


def test_column_functions_decode_as_the_interface_decoder(spark):
    from ledgerloom.operators.decode import with_decode

    seed = {"kinds": json.dumps([{"type": "event", "name": "K", "inputs": [{"name": "a", "type": "int64", "indexed": True}, {"name": 'b"é', "type": "bytes4"}, {"name": "c", "type": "bool"}, {"name": "d", "type": "uint8"}]}])}
    registry = AbiRegistry(seed)
    kinds = next(iter(registry.get("kinds")))
    rnd, rows = random.Random(4), []
    value = lambda: word(rnd.choice([0, 1, 255, 2**62, 2**63 - 1, 2**63, 2**200, -1, rnd.randrange(2**256)]))
    for n in range(400):
        ref, topic, many, words_ = rnd.choice([("erc20", TRANSFER, 2, 1), ("kinds", kinds, 1, 3), ("erc20", kinds, 1, 1), ("nested-orders", TRANSFER, 2, 1)])
        topics = [topic, *("0x" + value() for _ in range(many + rnd.choice([0, 0, 0, 0, 1, -1])))]
        data = rnd.choice(["0x", "0x", "0x", ""]) + "".join(value() for _ in range(words_ + rnd.choice([0, 0, 0, 1, -1])))
        data = rnd.choice([data, data, data, data.upper().replace("0X", "0x"), data[:-1], data + "zz"])
        rows.append((n, rnd.choice([topics, topics, topics, topics, [], [topic.upper()], ["0x12"] * 3, [topics[0], "0x12"], None]), rnd.choice([data, data, data, None]), ref, n % 10 != 0))
    df = spark.createDataFrame(rows, "n int, topics array<string>, data string, abi_ref string, wanted boolean")
    got = {r.n: r.d for r in with_decode(df, registry, F.col("wanted")).select("n", "d").collect()}
    for n, topics, data, ref, wanted in rows:
        assert (tuple(got[n]) if got[n] else None) == (decode_log(topics, data, ref, registry.all()) if wanted else None), (topics, data, ref)


def test_results_are_runs_that_merge(spark, tmp_path, monkeypatch):
    from ledgerloom.sinks import confirmed

    monkeypatch.setattr(confirmed, "MERGE_RUNS", 3)
    table = confirmed.ConfirmedEvents(spark, str(tmp_path / "t"))
    table.create()
    for n in range(8):
        rows = [("Transfer", "s", "base", "0xc", f"0x{k}", 0, 10_000 * n + k, "CONFIRMED" if n < 7 else "INVALIDATED", "WS", "{}", n, 0) for k in range(n, n + 3)]
        table.upsert(spark.createDataFrame(rows, confirmed.SCHEMA))
        assert table.count() == n + 3
    assert sorted(r["level"] for r in table.runs()) == [0, 0, 1, 1] and len(list((tmp_path / "t").glob("run-*"))) <= 8
    table.upsert(spark.createDataFrame([("Transfer", "s", "base", "0xc", "0x9", 0, 1, "CONFIRMED", "WS", "{}", 3, 0)], confirmed.SCHEMA))  # older: passed over
    assert table.find("base", "0x9", 0).first().status == "INVALIDATED" and table.find("base", "0x8", 0).first().block_number == 70_008
    assert sorted(r["level"] for r in table.runs()) == [2]
    table.truncate()
    assert table.count() == 0


def test_engine_stores_all_that_it_finds(spark, node, tmp_path):
    """Two polls and a push source into raw logs, a fork between them; then decode and lifecycle into all tables."""
    engine = Engine(spark, str(tmp_path / "e"), {"testnet": NetworkParams(12, 3)})
    engine.subscribe("testnet", "0xA", "erc20", 0)
    topics = [TRANSFER, "0x" + word(1), "0x" + word(2)]
    assert engine.poll("testnet", node, max_block_range=50) == 103 and engine.poll("testnet", node) == 103
    progress = spark.read.json(str(tmp_path / "e/poll-progress")).collect()
    assert [(r.progress_key, r.last_block) for r in progress] == [("testnet:0xa", 103)]
    writer, arrivals = engine.raw_writer(rows=4), rpc.Arrivals("WS")
    wire = lambda block, tx, fork="", address="0xA", data=9: {"address": address, "blockHash": f"0xb{block}{fork}", "blockNumber": hex(block), "data": "0x" + word(data), "logIndex": "0x0", "topics": topics, "transactionHash": tx}
    logs = [wire(104, "0xa1"), wire(105, "0xa2"), wire(105, "0xa3", "f"), wire(106, "0xa4", address="0xnobody"), *(wire(b, f"0xc{b}") for b in range(107, 125))]
    writer.emit([rpc.to_row(x, "testnet", "WS", 1, arrivals.next()) for x in logs])
    writer.flush()
    raw = spark.readStream.schema(RAW_LOG).parquet(str(tmp_path / "e/raw-logs"))
    changes = spark.readStream.schema(engine.changes().schema).json(str(tmp_path / "e/subscriptions")).withColumn("seq", F.col("seq") * 0)
    for _ in range(2):  # nothing new the second time
        engine.start(raw, changes, str(tmp_path / "check")).awaitTermination()
    n_polled = len(range(1, 104, 10))
    assert engine.topic("raw-logs").count() == n_polled + len(logs)
    dead = engine.topic("decode-dead-letters").collect()
    assert sorted(r.reason.split(" ")[0] for r in dead) == ["no"] + ["topic"] * n_polled and {r.raw_log.tx_hash for r in dead if r.reason.startswith("no ")} == {"0xa4"}
    assert engine.topic("decoded-logs").count() == len(logs) - 1
    ended = {(r.tx_hash, r.status) for r in engine.topic("confirmed-events").collect()}
    assert ("0xa2", "INVALIDATED") in ended and ("0xa1", "CONFIRMED") in ended and ("0xa3", "CONFIRMED") in ended
    assert {r.anomaly for r in engine.topic("reconciliation-anomalies").collect()} == {"POLL_ONLY_CONFIRMED"}
    assert {(r.tx_hash, r.status) for r in engine.snapshot().collect()} == ended
    assert all((tmp_path / "e" / t).exists() for t in ("subscriptions", "poll-progress")) and engine.subscription("nobody") is None
    entries = state_of(spark, str(tmp_path / "check/lifecycle"), "entries")
    assert entries.count() > 0


def decoded_rows(spark):
    rows = []
    for n in range(240):
        for k, network in enumerate(("ethereum", "base")):
            block = 100 + n // 4 - (1 if n % 50 == 49 else 0)
            fork = "f" if n % 60 in (41, 42) else ""
            rows.append((network, n * 2 + k, f"0x{n // 2}", k, block, f"h{block}{fork}", 1000 + n, *(("Transfer", TRANSFER, "0xc", "WS" if n % 3 else "POLL", json.dumps({"value": str(n // 2 + (n % 31 == 0))})) if n % 7 else (None, None, None, "WS", None))))
    return spark.createDataFrame(rows, "network string, seq bigint, tx_hash string, log_index bigint, block_number bigint, block_hash string, observed_at bigint, event_name string, signature_hash string, contract_address string, source string, decoded_fields string")


def test_stream_equals_batch_across_restarts(spark, tmp_path):
    rows = decoded_rows(spark)
    want = sorted(map(tuple, lifecycle_batch(rows).collect()), key=repr)
    assert {r[0] for r in want} == {"CONFIRMATION", "ANOMALY"} and {r[1] for r in want} == {"ethereum", "base"}
    for n in range(3):  # one file a batch, a restart from the checkpoint between them
        rows.where((F.col("seq") >= n * 160) & (F.col("seq") < (n + 1) * 160)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        lifecycle_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*lifecycle_batch(rows).columns).collect()), key=repr) == want


def random_history(spark, seed, n=260):
    """Heights that creep, jump and fall back; forks; keys seen again and again, at other heights, by either source."""
    rnd = random.Random(seed)
    rows, top = [], 100
    for seq in range(n):
        top += rnd.choice([0, 0, 0, 0, 1, 1, 1, 2, 9 if rnd.random() < 0.3 else 1])
        block = max(90, top - rnd.choice([0, 0, 0, 0, 1, 2, 5, 14]))
        fork = rnd.choice(["", "", "", "", "", "", "x", "y"]) if block % 3 == 0 else ""
        key = rnd.randrange(max(1, seq // 3 - 6), seq // 3 + 2) if rnd.random() < 0.8 else rnd.randrange(n // 3)
        event = ("Transfer", TRANSFER, "0xc", rnd.choice(["WS", "POLL"]), json.dumps({"value": str(key + (rnd.random() < 0.1))})) if rnd.random() < 0.8 else (None, None, None, "WS", None)
        rows.append(("testnet" if rnd.random() < 0.7 else "base", seq * 7, f"0x{key:03}", key % 2, block, f"h{block}{fork}", 1000 + seq, *event))
    return rows


HISTORY = "network string, seq bigint, tx_hash string, log_index bigint, block_number bigint, block_hash string, observed_at bigint, event_name string, signature_hash string, contract_address string, source string, decoded_fields string"


@pytest.mark.parametrize("options", [Options(), Options(require_poll=True), Options(invalidate_descendants=True)])
def test_sets_equal_the_fold_on_random_histories(spark, monkeypatch, options):
    monkeypatch.setattr(blocks, "BUCKET_ROWS", 64)
    rows = []
    for seed in range(60):  # each pair of networks is a history of its own
        rows += [(f"{r[0]}{seed}", *r[1:]) for r in random_history(spark, seed)]
    networks = {f"{name}{seed}": NetworkParams(depth, gap) for seed in range(60) for name, depth, gap in (("testnet", 2, 1), ("base", 6, 3))}
    df = spark.createDataFrame(rows, HISTORY)
    want = sorted(map(tuple, fold_in_order(df, networks, options).collect()), key=repr)
    assert {"CONFIRMED", "INVALIDATED"} <= {r[10] for r in want} and len({r[14] for r in want}) == 4
    assert sorted(map(tuple, lifecycle_batch(df, networks, options).collect()), key=repr) == want


def test_engine_round_trip(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), {"testnet": NetworkParams(2)})
    with pytest.raises(ValueError):
        engine.subscribe("testnet", "0xAA", "broken")
    old = engine.subscribe("testnet", "0xBB", "erc20")
    engine.subscribe("testnet", "0xAA", "erc20", 0, ["Transfer"])
    engine.unsubscribe(old["id"])
    with pytest.raises(KeyError):
        engine.unsubscribe("nobody")
    assert [r.address for r in engine.subscriptions("testnet").collect()] == ["0xAA"] and engine.subscriptions(status="all").count() == 2 and engine.subscriptions(status="odd").count() == 0
    logs = [("testnet", "0xaa" if n % 3 else "0xbb", f"0x{n}", 0, 100 + n, f"h{n}", [TRANSFER, "0x" + word(1), "0x" + word(2)], "0x" + word(n), "WS", n, n) for n in range(9)]
    raw_df = spark.createDataFrame(logs, RAW_LOG)
    out = engine.lifecycle(raw_df)
    for _ in range(2):
        engine.upsert_confirmed(out)
        assert [r.tx_hash for r in engine.snapshot().collect()] == ["0x1", "0x2", "0x4", "0x5"]
    assert engine.count_for_key("testnet", "0x4", 0) == 1 and json.loads(engine.find_by_key("testnet", "0x5", 0).first().decoded_fields)["value"] == "5"
    reasons = {r.reason for r in engine.decode_all(raw_df).where("reason is not null").collect()}
    assert reasons == {"subscription for network=testnet address=0xbb is REMOVED, not ACTIVE"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLES:
        oracle.same(df, oracle.connect(sf), catalog.ORACLES[name])
    else:
        assert df.count() > 0


def test_entry_works_without_the_text_operators(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "ledgerloom.llm.queries", None)  # importing it fails
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLES)
    assert entry.entry(spark).count() > 0
