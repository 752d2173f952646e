"""Wrapping of track keys for a trusted third party, on the driver, with the JVM's own providers.

RSA-OAEP with SHA-256 (also in its mask) and a label that both sides must state. Keys pass through
the driver and the sealing expressions only; don't log plans of a frame that holds them.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushline.functions import envelope

KEY_BYTES, LEAST_BITS = 32, 3072
#: Tracks that one job seals or opens; a conversation has a few.
MOST_TRACKS = 10_000


def fresh_key() -> bytes:
    return secrets.token_bytes(KEY_BYTES)


def key_pair(spark: SparkSession, bits: int = 4096) -> tuple[bytes, bytes]:
    """(public, private) as DER."""
    made = spark._jvm.java.security.KeyPairGenerator.getInstance("RSA")
    made.initialize(bits)
    pair = made.generateKeyPair()
    return bytes(_spec(spark, pair.getPublic(), "X509EncodedKeySpec").getEncoded()), bytes(_spec(spark, pair.getPrivate(), "PKCS8EncodedKeySpec").getEncoded())


def _spec(spark: SparkSession, key, name: str):
    """The key's parts; the provider's own key classes are closed to reflection."""
    jvm = spark._jvm
    return jvm.java.security.KeyFactory.getInstance("RSA").getKeySpec(key, jvm.java.lang.Class.forName(f"java.security.spec.{name}"))


def _cipher(spark: SparkSession, mode: int, der: bytes, label: bytes):
    jvm = spark._jvm
    factory, spec = jvm.java.security.KeyFactory.getInstance("RSA"), jvm.java.security.spec
    key = factory.generatePublic(spec.X509EncodedKeySpec(der)) if mode == 1 else factory.generatePrivate(spec.PKCS8EncodedKeySpec(der))
    if _spec(spark, key, "RSAPublicKeySpec" if mode == 1 else "RSAPrivateKeySpec").getModulus().bitLength() < LEAST_BITS:
        raise ValueError(f"RSA keys need at least {LEAST_BITS} bits")
    crypto = jvm.javax.crypto
    source = getattr(crypto.spec, "PSource$PSpecified")(label)
    cipher = crypto.Cipher.getInstance("RSA/ECB/OAEPPadding")
    cipher.init(mode, key, crypto.spec.OAEPParameterSpec("SHA-256", "MGF1", spec.MGF1ParameterSpec.SHA256, source))
    return cipher


def wrap(spark: SparkSession, key: bytes, public: bytes, label: bytes) -> str:
    return base64.b64encode(bytes(_cipher(spark, 1, public, label).doFinal(key))).decode()


def unwrap(spark: SparkSession, wrapped: str, private: bytes, label: bytes) -> bytes:
    """The key; raises where the label, the private key or any byte differs, or it is no 256-bit key."""
    key = bytes(_cipher(spark, 2, private, label).doFinal(base64.b64decode(wrapped, validate=True)))
    if len(key) != KEY_BYTES:
        raise ValueError("not a 256-bit key")
    return key


def fingerprint(public: bytes) -> str:
    return hashlib.sha256(public).hexdigest()


def protect(tracks: DataFrame, public: bytes, label: bytes) -> tuple[DataFrame, list[dict]]:
    """(track_id, source_file, plain, aad) -> sealed tracks, and a manifest record for each with its wrapped key.

    Every track has a key of its own. The sealed frame draws nonces when it runs: write it before reading it twice.
    """
    spark = tracks.sparkSession
    ids = [r[0] for r in tracks.select("track_id").distinct().orderBy("track_id").limit(MOST_TRACKS + 1).collect()]
    if len(ids) > MOST_TRACKS:
        raise ValueError(f"over {MOST_TRACKS} tracks in one job")
    keys = {i: fresh_key() for i in ids}
    known = spark.createDataFrame([(i, k) for i, k in keys.items()], "track_id string, key binary")
    sealed = tracks.join(F.broadcast(known), "track_id").withColumn("sealed", envelope.seal(F.col("plain"), F.col("key"), F.col("aad")))
    out = sealed.select("track_id", "source_file", "aad", "sealed", F.length("plain").alias("plaintext_bytes"), F.sha2("plain", 256).alias("plaintext_sha256"))
    return out, [{"track_id": i, "wrapped_key_b64": wrap(spark, k, public, label)} for i, k in keys.items()]


def release(spark: SparkSession, manifest: list[dict], approved: set[str], private: bytes, label: bytes, consent: str) -> dict:
    """The unwrapped keys of approved tracks, by id, never of others; an unknown id raises."""
    records = {r["track_id"]: r for r in manifest}
    if unknown := sorted(approved - set(records)):
        raise ValueError("unknown tracks: " + ", ".join(unknown))
    tracks = [{"track_id": i, "key_b64": base64.b64encode(unwrap(spark, records[i]["wrapped_key_b64"], private, label)).decode()} for i in sorted(approved)]
    return {"issued_at_utc": datetime.datetime.now(datetime.UTC).isoformat(), "consent_reference": consent, "approved_tracks": tracks}


def open_released(sealed: DataFrame, released: dict) -> DataFrame:
    """track_id, source_file, plain of the released tracks; bytes that don't open or don't match their digest raise when read."""
    known = sealed.sparkSession.createDataFrame([(t["track_id"], base64.b64decode(t["key_b64"])) for t in released["approved_tracks"]], "track_id string, key binary")
    got = sealed.join(F.broadcast(known), "track_id").withColumn("plain", envelope.opened(F.col("sealed"), F.col("key"), F.col("aad")))
    fine = F.sha2("plain", 256).eqNullSafe(F.col("plaintext_sha256"))
    return got.select("track_id", "source_file", F.when(fine, F.col("plain")).otherwise(F.raise_error(F.concat(F.lit("does not open: "), "track_id")).cast("binary")).alias("plain"))


def open_fingerprints(sealed: DataFrame, manifest: list[dict], private: bytes, label: bytes) -> DataFrame:
    """track_id, source_file, plain of every sealed record: the third party's own use of its key, without a release."""
    everything = release(sealed.sparkSession, manifest, {r["track_id"] for r in manifest}, private, label, "")
    return open_released(sealed, everything)
