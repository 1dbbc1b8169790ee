"""The audit log: hash chains of retrievals, signatures and their verification."""

from __future__ import annotations

import base64
import functools
import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramite.plans.numbers import numbered
from engramite.plans.scratch import discard, materialize
from engramite.plans.ship import ship_package


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def stored_score(score: Column) -> Column:
    """Ten-thousandths, as a whole number; no score is 0."""
    return F.coalesce(F.round(score * 10000).cast("bigint"), F.lit(0).cast("bigint"))


def attestation_id(*parts: Column) -> Column:
    """An id in the form of a UUID that is made of the record itself, so a task that runs twice gives it the same."""
    h = F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{k}") for k, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def linked(payload: Column, previous: Column) -> Column:
    """What a record's hash covers: its payload and the hash of the record before it."""
    return F.sha2(F.concat_ws("|", F.coalesce(payload, F.lit("")), F.coalesce(previous, F.lit(""))), 256)


def _streamed(rows: DataFrame, key: str, order: str, carry: list[str], added: list[str], step, last: dict[str, str] | None = None) -> DataFrame:
    """Adds columns of text: step(state, row) -> (state, values), over the rows of each key in order. A chain has one place after another, so one task walks
    each key; it holds one record and streams."""
    ship_package(rows.sparkSession)
    rows = rows.repartition(key).sortWithinPartitions(key, order)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), *(f"{c} string" for c in added)])

    def run(batches):
        current, state = None, None
        for batch in batches:
            out, keys = [], batch.column(key).to_pylist()
            for k, row in zip(keys, batch.to_pylist(), strict=True):
                if state is None or k != current:
                    current, state = k, ((last or {}).get(k),)
                state, values = step(state, row)
                out.append(values)
            made = [pa.array([v[i] for v in out], pa.string()) for i in range(len(added))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *made], names=[*carry, *added])

    return rows.mapInArrow(run, schema)


def chain(records: DataFrame, key: str, order: str, payload: Column) -> DataFrame:
    """Adds previous_hash and own_hash: within each key, a record names the hash of the one before it, and its own hash covers that name and its
    payload; so an edit shows in the record itself, or, with its hash made anew, in the one after it. Null payloads are empty."""
    rows = records.withColumn("__payload", F.coalesce(payload, F.lit("")))

    def step(state, row):
        own = hashlib.sha256(f"{row['__payload']}|{state[0] or ''}".encode()).hexdigest()
        return (own,), (state[0], own)

    return _streamed(rows, key, order, records.columns, ["previous_hash", "own_hash"], step)


def verify(records: DataFrame, key: str, order: str, payload: Column) -> DataFrame:
    """Adds content_ok, whether a record's hash is that of its payload and link, and link_ok, whether its link is the hash of the record before it.
    Neither needs the order of a walk: all records are judged in parallel."""
    before = F.lag("own_hash").over(Window.partitionBy(key).orderBy(order))
    judged = records.withColumn("link_ok", before.eqNullSafe(F.col("previous_hash")))
    return judged.withColumn("content_ok", linked(payload, F.col("previous_hash")).eqNullSafe(F.col("own_hash")))


def trusted_up_to(verified: DataFrame, key: str, order: str) -> DataFrame:
    """Adds chain_ok to verified records: whether they and all records before them in their chain are whole."""
    bad = F.when(F.col("content_ok") & F.col("link_ok"), 0).otherwise(1)
    return verified.withColumn("chain_ok", F.max(bad).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) == 0)


RECORD = ("chain", "id", "attestation_id", "query", "timestamp", "memories_retrieved", "agent_id", "session_id")
# Keys of a record, in the order in which they are signed.
FIELDS = ("attestation_id", "query", "timestamp", "memories_retrieved", "agent_id", "session_id", "previous_hash")
MAX_CHAIN = 10_000
MISMATCH, FORGED, BROKEN = "Attestation hash mismatch", "Signature verification failed", "Broken chain"


def retrieved(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, rank, id, content, score): what each retrieval gave, as the items of a record; null contents hash as empty."""
    item = F.struct("rank", F.struct("id", content_hash(F.coalesce("content", F.lit(""))).alias("content_hash"), stored_score(F.col("score")).alias("score")).alias("item"))
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]).alias("memories_retrieved"))


def document(row: dict, previous: str | None) -> str:
    """The JSON that is signed: keys in their order, nulls written, no spaces; empty texts of agent and session are null."""
    said = dict(row, agent_id=row["agent_id"] or None, session_id=row["session_id"] or None, previous_hash=previous or None, memories_retrieved=row["memories_retrieved"] or [])
    return json.dumps({f: said[f] for f in FIELDS}, ensure_ascii=False, separators=(",", ":"))


def record_hash(signed: str, signature: str | None) -> str:
    return hashlib.sha256(f"{signed[:-1]},\"signature\":{json.dumps(signature)}}}".encode("utf-8", "surrogatepass")).hexdigest()


def attest(records: DataFrame, keys: Keys, last: dict[str, str] | None = None) -> DataFrame:
    """records of RECORD: adds previous_hash, signature and hash. Within a chain, in the order of ids, each record names the hash of the one
    before it, is signed with that name, and its hash covers the signature; signing runs in tasks, with the keys broadcast. last: the hash with which
    a chain ended before, for chains that go on."""
    rows = records.select(*RECORD)
    shared = records.sparkSession.sparkContext.broadcast(keys.raw())

    def step(state, row):
        seed, public = shared.value
        signed = document(row, state[0])
        signature = sign_with(seed, public, signed.encode("utf-8", "surrogatepass")).hex()
        own = record_hash(signed, signature)
        return (own,), (state[0], signature, own)

    return _streamed(rows, "chain", "id", list(RECORD), ["previous_hash", "signature", "hash"], step, last)


def verify_records(records: DataFrame, public: bytes) -> DataFrame:
    """Adds error, null for a record that is whole: its hash is that of what it says, the key signed it, and a whole record of a smaller id in
    the store has the hash it names, and so on to one that names none. All records are judged in parallel, then chains by walk_links."""
    ship_package(records.sparkSession)
    rows = records.select("chain", "id", *[f for f in FIELDS if f != "chain"], "signature", "hash")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                signed = document(row, row["previous_hash"])
                if record_hash(signed, row["signature"]) != row["hash"]:
                    out.append(MISMATCH)
                    continue
                try:
                    good = verify_with(public, signed.encode("utf-8", "surrogatepass"), bytes.fromhex(row["signature"] or ""))
                except ValueError:  # no hexadecimal text
                    good = False
                out.append(None if good else FORGED)
            yield pa.RecordBatch.from_arrays([batch.column("chain"), batch.column("id"), batch.column("hash"), batch.column("previous_hash"), pa.array(out, pa.string())], names=["chain", "id", "hash", "previous_hash", "own_error"])

    judged = materialize(rows.mapInArrow(run, "chain string, id bigint, hash string, previous_hash string, own_error string"), "judged")
    walked = walk_links(judged.select(F.struct("chain", "id").alias("key"), "id", "hash", "previous_hash", "own_error"))
    return records.join(walked.select("key.chain", "key.id", "error"), ["chain", "id"], "left")


def walk_links(records: DataFrame, most: int = MAX_CHAIN) -> DataFrame:
    """records(key, id, hash, previous_hash, own_error): (key, depth, error). A record is whole if it is so itself and if the way back from it, each time to the record
    that has the hash named, is: that record exists, has a smaller id and is whole itself. The error is the first on the way; a way of over ``most`` links is one too. depth
    counts the links to the beginning, or to the first fault. Of several records with one hash the one of the smallest id is meant. Records that two writers put
    behind the same one are two ways. Null and empty previous hashes begin a chain; null hashes are found by none.

    All ways are walked at once: each record knows how far it has come, and jumps on by as far as the record has come where it stands, so rounds grow
    with the logarithm of the longest chain. Ids fall along a way, so no way is a circle."""
    named = F.col("previous_hash") != ""
    found = records.where("hash is not null").groupBy("hash").agg(F.min_by(F.struct("key", "id", "own_error"), F.struct("id", "key")).alias("p"))
    rows = records.join(found.withColumnRenamed("hash", "__hash"), named & (F.col("previous_hash") == F.col("__hash")), "left")
    fault = (
        F.when(~F.coalesce(named, F.lit(False)), None).when(F.col("p").isNull(), F.concat(F.lit(f"{BROKEN}: Previous attestation with hash "), "previous_hash", F.lit(" not found")))
        .when(F.col("p.id") >= F.col("id"), f"{BROKEN}: Invalid sequence order").when(F.col("p.own_error").isNotNull(), F.concat(F.lit(f"{BROKEN}: Previous link is invalid: "), "p.own_error"))
    )
    go_on = F.col("fault").isNull() & F.coalesce(named, F.lit(False))
    rows = rows.withColumn("fault", fault).select("key", "own_error", "fault", F.when(go_on, F.col("p.key")).alias("next"), F.when(go_on, 1).otherwise(0).cast("bigint").alias("depth"))
    state = materialize(rows, "links")
    while not state.where("next is not null").isEmpty():
        there = state.select(F.col("key").alias("next"), F.col("next").alias("beyond"), F.col("fault").alias("later"), F.col("depth").alias("more"))
        jumped = state.join(there, "next", "left").select("key", "own_error", F.coalesce("fault", "later").alias("fault"), F.col("beyond").alias("next"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        before, state = state, materialize(jumped, "links")
        discard(before)
    # a fault at the end of a way is one link further on
    links = F.col("depth") + F.col("fault").isNotNull().cast("int")
    error = F.coalesce("own_error", F.when(links > most, f"{BROKEN}: chain length exceeds maximum"), "fault")
    return state.select("key", "depth", error.alias("error"))


def export_report(records: DataFrame, stats: DataFrame, start: str | None, end: str | None, exported_at: str, error: str = "error") -> DataFrame:
    """records with their verification, within a range of time, and the ledger of agents: (section, position, json, line), the parts of an
    export as JSON and as lines of Markdown, in their order: the summary, agents by reputation, records by id. The summary says when and for which range the export
    was made and whether every record shown is whole; a record that is not says why in its own line."""
    shown = _within(records, start, end)
    count = shown.agg(F.count("*").alias("total_attestations"), (F.count(F.col(error)) == 0).alias("whole"))
    state = F.when(F.col("whole"), "SECURE").otherwise("COMPROMISED")
    head = F.struct(F.lit(exported_at).alias("exported_at"), F.lit(start or "").alias("start_date"), F.lit(end or "").alias("end_date"), "total_attestations", state.alias("system_integrity"))
    made = F.lit(f"Exported at: `{exported_at}`, period: `{start or ''}` to `{end or ''}`, total audit records: **")
    line = F.concat(made, F.col("total_attestations").cast("string"), F.lit("**, status: **"), state, F.lit("**"))
    summary = count.select(F.lit("summary").alias("section"), F.lit(0).cast("bigint").alias("position"), F.to_json(head).alias("json"), line.alias("line"))
    cells = F.concat_ws(" | ", F.concat(F.lit("| `"), "agent_id", F.lit("`")), "memories_created", "memories_confirmed", "memories_contradicted", F.concat(F.lit("**"), F.format_number("reputation_score", 2), F.lit("** |")))
    ledger = numbered(stats, [F.desc("reputation_score"), F.asc("agent_id")], "position", 1).select(F.lit("agents").alias("section"), "position", F.to_json(F.struct(*stats.columns)).alias("json"), cells.alias("line"))
    items = F.concat_ws("; ", F.transform("memories_retrieved", lambda m: F.concat(F.lit("ID: `"), m["id"].cast("string"), F.lit("`, Hash: `"), m["content_hash"], F.lit("`, Score: `"), m["score"].cast("string"), F.lit("`"))))
    told = F.concat_ws(
        " — ", F.concat(F.lit("### Attestation `"), "attestation_id", F.lit("`")), "timestamp", F.coalesce("agent_id", F.lit("shared")), "query", F.coalesce("previous_hash", F.lit("GENESIS")), "hash",
        F.concat(F.lit("Signature: `"), F.substring("signature", 1, 32), F.lit("...`")), F.when(items != "", items).otherwise("None"), F.concat(F.lit("**"), F.col(error), F.lit("**")),
    )
    trail = shown.select(F.lit("attestations").alias("section"), F.col("id").alias("position"), F.to_json(F.struct(*shown.columns), {"ignoreNullFields": "false"}).alias("json"), told.alias("line"))
    place = F.array_position(F.array(F.lit("summary"), F.lit("agents"), F.lit("attestations")), F.col("section"))
    return summary.unionByName(ledger).unionByName(trail).orderBy(place, "position")


def in_range(records: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """ISO times compared as text, both ends included, in the order of ids."""
    return _within(records, start, end).orderBy("id")


def _within(records: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start:
        records = records.where(F.col("timestamp") >= start)
    if end:
        records = records.where(F.col("timestamp") <= end)
    return records


class Keys:
    """An Ed25519 pair of the JVM. Signing and verifying happen on the driver, for single records; sign_heads does whole tables."""

    def __init__(self, spark: SparkSession, private: str | None = None, public: str | None = None):
        self.jvm = spark.sparkContext._jvm
        if private is None:
            pair = self.jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
            self._private, self._public = pair.getPrivate(), pair.getPublic()
        else:
            factory = self.jvm.java.security.KeyFactory.getInstance("Ed25519")
            self._private = factory.generatePrivate(self.jvm.java.security.spec.PKCS8EncodedKeySpec(base64.b64decode(private)))
            self._public = factory.generatePublic(self.jvm.java.security.spec.X509EncodedKeySpec(base64.b64decode(public)))

    def export(self) -> tuple[str, str]:
        factory, form = self.jvm.java.security.KeyFactory.getInstance("Ed25519"), self.jvm.java.lang.Class.forName
        specs = factory.getKeySpec(self._private, form("java.security.spec.PKCS8EncodedKeySpec")), factory.getKeySpec(self._public, form("java.security.spec.X509EncodedKeySpec"))
        return tuple(base64.b64encode(bytes(x.getEncoded())).decode() for x in specs)

    def raw(self) -> tuple[bytes, bytes]:
        """The 32 bytes of the private and of the public key, with which both encodings end."""
        return tuple(base64.b64decode(k)[-32:] for k in self.export())

    def sign(self, message: str) -> str:
        s = self.jvm.java.security.Signature.getInstance("Ed25519")
        s.initSign(self._private)
        s.update(message.encode())
        return base64.b64encode(bytes(s.sign())).decode()

    def verify(self, message: str, signature: str) -> bool:
        s = self.jvm.java.security.Signature.getInstance("Ed25519")
        s.initVerify(self._public)
        s.update(message.encode())
        try:
            return bool(s.verify(base64.b64decode(signature)))
        except Exception:  # a signature of another length
            return False


# Ed25519 as in RFC 8032, for tasks, which have no JVM at hand. Points are (X, Y, Z, T) with x = X / Z, y = Y / Z, xy = T / Z.
_P, _Q = 2**255 - 19, 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, _P - 2, _P) % _P


def _add(a: tuple, b: tuple) -> tuple:
    w, x = (a[1] - a[0]) * (b[1] - b[0]) % _P, (a[1] + a[0]) * (b[1] + b[0]) % _P
    y, z = 2 * a[3] * b[3] * _D % _P, 2 * a[2] * b[2] % _P
    e, f, g, h = x - w, z - y, z + y, x + w
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _pack(a: tuple) -> bytes:
    z = pow(a[2], _P - 2, _P)
    return (a[1] * z % _P | (a[0] * z % _P & 1) << 255).to_bytes(32, "little")


def _unpack(data: bytes) -> tuple | None:
    y = int.from_bytes(data, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    if y >= _P:
        return None
    square = (y * y - 1) * pow(_D * y * y + 1, _P - 2, _P) % _P
    x = pow(square, (_P + 3) // 8, _P)
    if (x * x - square) % _P:
        x = x * pow(2, (_P - 1) // 4, _P) % _P
    if (x * x - square) % _P or (x == 0 and sign):
        return None
    x = x if x & 1 == sign else _P - x
    return x, y, 1, x * y % _P


def _multiples(point: tuple) -> list[list[tuple]]:
    """For each byte of a scalar, the multiples of the point that it may stand for: (y - x, y + x, 2dxy) with Z = 1, so that a product is 32 short additions."""
    out = []
    for _ in range(32):
        row, at = [], (0, 1, 1, 0)
        for _ in range(256):
            row.append(at)
            at = _add(at, point)
        out.append(row)
        point = at
    flat = [a for row in out for a in row]
    before, product = [], 1
    for a in flat:  # all divisions by Z at the price of one
        before.append(product)
        product = product * a[2] % _P
    inverse, small = pow(product, _P - 2, _P), []
    for a, head in zip(reversed(flat), reversed(before), strict=True):
        z, inverse = inverse * head % _P, inverse * a[2] % _P
        x, y = a[0] * z % _P, a[1] * z % _P
        small.append(((y - x) % _P, (y + x) % _P, 2 * _D * x * y % _P))
    small.reverse()
    return [small[k : k + 256] for k in range(0, len(small), 256)]


_BASE = _unpack((4 * pow(5, _P - 2, _P) % _P).to_bytes(32, "little"))


@functools.lru_cache(maxsize=4)
def _base_table() -> list[list[tuple]]:
    return _multiples(_BASE)


@functools.lru_cache(maxsize=4)
def _key_table(public: bytes) -> list[list[tuple]] | None:
    """Of the point that a public key is, turned about; None for what is no key."""
    a = _unpack(public)
    return None if a is None else _multiples((-a[0] % _P, a[1], 1, -a[3] % _P))


def _sum(*terms: tuple[int, list[list[tuple]]]) -> tuple:
    """The sum of scalars below 2^256 times the points of their tables."""
    x, y, z, t = 0, 1, 1, 0
    for n, table in terms:
        for byte, row in zip(n.to_bytes(32, "little"), table, strict=True):
            if byte:
                less, more, twice = row[byte]
                a, b, c, d = (y - x) * less % _P, (y + x) * more % _P, t * twice % _P, 2 * z
                e, f, g, h = b - a, d - c, d + c, b + a
                x, y, z, t = e * f % _P, g * h % _P, f * g % _P, e * h % _P
    return x, y, z, t


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def sign_with(seed: bytes, public: bytes, message: bytes) -> bytes:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254
    r = _number(h[32:], message) % _Q
    start = _pack(_sum((r, _base_table())))
    return start + ((r + _number(start, public, message) * a) % _Q).to_bytes(32, "little")


def verify_with(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(signature) != 64 or (s := int.from_bytes(signature[32:], "little")) >= _Q:
        return False
    if (key := _key_table(public)) is None:
        return False
    # s times the base less the hash times the key is the point at the beginning, which has one spelling
    return _pack(_sum((s, _base_table()), (_number(signature[:32], public, message) % _Q, key))) == signature[:32]


def sign_heads(heads: DataFrame, keys: Keys) -> DataFrame:
    """heads(user_id, head): adds signature, whether it verifies, and whether it does for another text. In tasks, with the keys broadcast."""
    spark = heads.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(keys.raw())

    def run(batches):
        seed, public = shared.value
        for batch in batches:
            texts = [h.encode() for h in batch.column("head").to_pylist()]
            made = [sign_with(seed, public, t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("user_id"), batch.column("head"), pa.array([base64.b64encode(x).decode() for x in made], pa.string()),
                    pa.array([verify_with(public, t, x) for t, x in zip(texts, made, strict=True)], pa.bool_()), pa.array([verify_with(public, t + b"x", x) for t, x in zip(texts, made, strict=True)], pa.bool_()),
                ],
                names=["user_id", "head", "signature", "verified", "forged"],
            )

    rows = heads.selectExpr("cast(user_id as bigint) as user_id", "head").where("head is not null")
    rows = rows.repartition(spark.sparkContext.defaultParallelism)  # heads are few bytes, which adaptive execution would hand to one task
    return rows.mapInArrow(run, "user_id bigint, head string, signature string, verified boolean, forged boolean")
