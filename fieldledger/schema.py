"""Tables, vocabularies and protocol constants."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    """'name:kind' words; a ? after the kind allows nulls."""
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "v": T.ArrayType(T.StringType(), False)}
    fields = []
    for word in text.split():
        name, kind = word.split(":")
        fields.append(T.StructField(name, kinds[kind[0]], kind.endswith("?")))
    return T.StructType(fields)


# The column names and the vocabularies are the data model's own.
CHAIN_TAIL = "event_type:s {actor}:s reason:s created_at:s payload_json:s prev_hash:s entry_hash:s"
TABLES: dict[str, T.StructType] = {
    "actors": _struct("actor_id:s display_name:s kind:s created_at:s"),
    "memories": _struct("memory_id:s content:s content_sha256:s embedding:v embedding_model:s topic:s? created_by:s created_at:s"),
    "custody_chain": _struct("memory_id:s seq:i " + CHAIN_TAIL.format(actor="actor_id")),
    "authority_chain": _struct("subject_id:s seq:i " + CHAIN_TAIL.format(actor="issuer_id")),
    "claim_chain": _struct("claim_id:s seq:i " + CHAIN_TAIL.format(actor="actor_id")),
    "ledger_root": _struct("singleton:i actor_id:s created_at:s"),
    "governance": _struct("singleton:i grant_holders:i"),
    "cell_links": _struct("from_id:s to_id:s link_type:s auto:i created_at:s"),
    "taint_sweeps": _struct("sweep_id:s quarantined_actor:s initiated_by:s reason:s created_at:s flagged_count:i flagged_ids_sha256:s"),
    "recall_receipts": _struct("receipt_sha256:s query_sha256:s seed_memory_id:s? served_json:s excluded_custody:i excluded_forgotten:i excluded_inhibited:i top_k:i hops:i ranking_protocol:s custody_override_json:s as_of:s? persisted_at:s"),
    "decisions": _struct("decision_id:s receipt_sha256:s decision_sha256:s policy_version:s actor_id:s reason:s used_json:s created_at:s record_sha256:s"),
    "claims": _struct("claim_id:s statement:s statement_sha256:s topic:s? created_by:s created_at:s"),
    "claim_sets": _struct("set_id:s constraint_type:s topic:s? reason:s created_by:s created_at:s members_json:s members_sha256:s"),
}

CUSTODY_EVENTS_1_0 = ("STORED", "REINFORCED", "CONTRADICTED_BY", "SUPERSEDED_BY", "QUARANTINED", "TAINT_FLAGGED", "REHABILITATED", "STATE_CHANGED")
CUSTODY_EVENTS = (*CUSTODY_EVENTS_1_0, "DECISION_USED_MEMORY")
AUTHORITY_EVENTS = ("ACTOR_REGISTERED", "GRANTED", "REVOKED", "ACTOR_QUARANTINED", "ACTOR_REINSTATED")
CLAIM_EVENTS = ("CLAIM_ASSERTED", "EVIDENCE_LINKED", "RELATED_TO", "SET_MEMBERSHIP", "CLAIM_VALIDATED", "CLAIM_REFUTED", "CLAIM_WITHDRAWN", "CLAIM_SUPERSEDED")
CAPABILITIES = ("STORE", "REINFORCE", "SUPERSEDE", "QUARANTINE_ACTOR", "QUARANTINE_MEMORY", "REHABILITATE", "GRANT", "REVOKE", "DECIDE", "ASSERT", "ADJUDICATE", "COUNTERFACTUAL")
NON_INFLUENCE = ("CONTRADICTED_BY", "DECISION_USED_MEMORY")
KINDS = ("AGENT", "PIPELINE", "HUMAN", "SYSTEM")
FIELD_STATES = ("REINFORCED", "NEUTRAL", "FORGOTTEN")
CUSTODY_STATUSES = ("CLEAN", "TAINT_FLAGGED", "QUARANTINED", "SUPERSEDED")
STANCES = ("SUPPORTS", "CONTRADICTS")
CONSTRAINTS = ("AT_MOST_ONE", "EXACTLY_ONE", "INCOMPATIBLE")

#: What an event costs: the capability that its actor must hold.
CUSTODY_CAPABILITY = {
    "STORED": "STORE", "REINFORCED": "REINFORCE", "CONTRADICTED_BY": "STORE", "SUPERSEDED_BY": "SUPERSEDE", "QUARANTINED": "QUARANTINE_MEMORY",
    "TAINT_FLAGGED": "QUARANTINE_ACTOR", "REHABILITATED": "REHABILITATE", "STATE_CHANGED": "REINFORCE", "DECISION_USED_MEMORY": "DECIDE",
}
AUTHORITY_CAPABILITY = {"ACTOR_REGISTERED": "GRANT", "GRANTED": "GRANT", "REVOKED": "REVOKE", "ACTOR_QUARANTINED": "QUARANTINE_ACTOR", "ACTOR_REINSTATED": "QUARANTINE_ACTOR"}
CLAIM_CAPABILITY = {
    "CLAIM_ASSERTED": "ASSERT", "EVIDENCE_LINKED": "ASSERT", "RELATED_TO": "ASSERT", "SET_MEMBERSHIP": "ASSERT",
    "CLAIM_VALIDATED": "ADJUDICATE", "CLAIM_REFUTED": "ADJUDICATE", "CLAIM_WITHDRAWN": "ASSERT", "CLAIM_SUPERSEDED": "ASSERT",
}

PROTOCOLS = {
    "custody_protocol": "1.1.0", "replay_protocol": "1.1.0", "ranking_protocol": "1.0.0", "taint_protocol": "2.0.0",
    "authority_protocol": "1.3.0", "receipt_protocol": "2.0.0", "claim_protocol": "1.1.0",
}
QUANTIZATION = "canonical-decimal/scale=10/rounding=ROUND_HALF_EVEN"
INITIAL_CONFIDENCE = "0.5000000000"
PROMOTION = "0.7500000000"
MAX_HOPS, DEFAULT_HOPS, DEFAULT_TOP_K = 10, 2, 5
EXPOSURE_DEPTH = 6
#: What a service lets in: characters of a text and of an identifier, and the least and most of top_k and hops.
MAX_TEXT, MAX_ID = 50_000, 64
TOP_K_RANGE, HOPS_RANGE = (1, 20), (0, 4)
#: Patterns of identifiers, digests and instants.
ID_PATTERN = r"^[a-zA-Z0-9_\-.:]{1,64}$"
HEX_PATTERN = r"^[0-9a-f]{64}$"
TS_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}\+00:00$"
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"


@dataclass(frozen=True)
class Profile:
    """What tells one engine's chains and bundles from another's.

    custody, authority and claim begin the text whose digest is a chain's genesis, empty_heads is
    the text sealed where there are no heads, and bundle names the bundle format. Chains and
    bundles of another engine with the same rules are built and verified under its own profile.
    """

    custody: str
    authority: str
    claim: str
    empty_heads: str
    bundle: str


#: The profile of this engine.
OWN = Profile("fieldledger/custody/", "fieldledger/authority/", "fieldledger/claim/", "fieldledger/no-heads", "fieldledger-bundle-1")
_using: ContextVar[Profile] = ContextVar("profile", default=OWN)


def profile() -> Profile:
    """The profile in use, by this thread or task."""
    return _using.get()


@contextmanager
def under(other: Profile) -> Iterator[Profile]:
    """Everything planned inside the block belongs to the other profile."""
    before = _using.set(other)
    try:
        yield other
    finally:
        _using.reset(before)


@dataclass(frozen=True)
class ChainKind:
    """One of the three chains: its columns and its vocabulary."""

    name: str
    table: str
    subject: str
    actor: str
    birth: str
    events: tuple[str, ...]

    @property
    def prefix(self) -> str:
        """What begins a genesis, under the profile in use."""
        return getattr(profile(), self.name)


CUSTODY = ChainKind("custody", "custody_chain", "memory_id", "actor_id", "STORED", CUSTODY_EVENTS)
AUTHORITY = ChainKind("authority", "authority_chain", "subject_id", "issuer_id", "ACTOR_REGISTERED", AUTHORITY_EVENTS)
CLAIM = ChainKind("claim", "claim_chain", "claim_id", "actor_id", "CLAIM_ASSERTED", CLAIM_EVENTS)
