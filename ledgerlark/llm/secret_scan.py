"""Secret scan: patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import prepare, text_or_empty

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
# Candidates of the models, which also hold every match of the two patterns above.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Kinds of spans, in their order at one start.
KINDS = ("assign", "access", "hex", "random")

# Ordinary identifiers, the labelled samples of the second model.
IDENTIFIERS = """
get_user_by_email max_connection_pool_size default_retry_interval_ms parse_command_line_arguments is_valid_checksum
read_partition_metadata number_of_shuffle_partitions left_outer_join_condition compute_daily_returns last_updated_timestamp
application_configuration http_request_handler write_ahead_log_segment customer_account_balance test_empty_input_returns_none
getElementById setConnectionTimeout calculateMovingAverage serializeToJsonString isAuthenticatedRequest createTemporaryDirectory
validateEmailAddress onSubscriptionCancelled DataFrameWriterOptions AbstractSingletonFactoryBean UnsupportedOperationException
ConcurrentModificationHandler ResourceNotFoundError MessageQueueConsumerGroup IllegalArgumentException NetworkInterfaceController
org/apache/commons/lang/StringUtils usr/local/share/applications/editor docs/guides/getting-started/installation
src/main/resources/templates/index static/assets/images/header-background content-security-policy access-control-allow-origin
x-forwarded-for-original-address multi-factor-authentication-settings publication-quality-figures state-of-the-art-methods
MAXIMUM_TRANSMISSION_UNIT DEFAULT_BUFFER_SIZE_BYTES ENVIRONMENT_VARIABLE_PREFIX HTTP_STATUS_INTERNAL_ERROR COPYRIGHT_NOTICE_TEXT
internationalization responsibilities characteristically counterproductive straightforwardness transformational
unwahrscheinlichkeit Geschwindigkeitsbegrenzung Verantwortungsbewusstsein Lebensversicherungsgesellschaft Zusammenarbeitsvertrag
desafortunadamente responsabilidades internacionalmente caracteristicamente inconstitucionalidad electroencefalografista
anticonstitutionnellement malheureusement particulierement developpement-durable gouvernementalisation reconnaissances
version2_release_candidate1 table_name_2024_01_15 chapter12-section3-exercises utf8_general_case_insensitive sha256_file_checksum
invoice_2023_customer_export column1_column2_column3 backup-2024-03-31-full-archive page_1_of_10_introduction mp4_video_encoder_h264
________________________________ -------------------------------- ================================ aaaaaaaaaaaaaaaaaaaaaaaa
telecommunications misunderstandings incomprehensibilities disproportionately electromagnetically institutionalisation
Krankenversicherungsbeitrag Gesellschaftsvertrag Bundesverfassungsgericht Arbeitsgenehmigungsverfahren Wiederherstellungszeitpunkt
gubernamentalmente contrarrevolucionario desproporcionadamente establecimientos descentralizaciones industrializaciones
internationalisation approvisionnements constitutionnellement professionnellement desintegrations rafraichissements
""".split()

_ALPHABET = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-")}
_N = len(_ALPHABET)


def random_samples(n: int = 3000, seed: int = 11) -> list[str]:
    """Labelled random strings by rule: seeded draws of 20 to 64 characters from the alphabets of keys."""
    r = random.Random(seed)
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
    return ["".join(r.choices(r.choice(alphabets), k=r.randint(20, 64))) for _ in range(n)]


def markov_model(samples: Sequence[str], add: float = 0.5) -> list[list[float]]:
    """Log probabilities of a character after another, with ``add`` added to each count; the last row is for the first character."""
    counts = [[add] * _N for _ in range(_N + 1)]
    for s in samples:
        for a, b in zip([_N, *(_ALPHABET[c] for c in s)], (_ALPHABET[c] for c in s)):
            counts[a][b] += 1
    return [[math.log(x / sum(row)) for x in row] for row in counts]


@lru_cache(2)
def _ratios(extra_random: tuple[str, ...], extra_ordinary: tuple[str, ...]) -> list[list[float]]:
    """Log-likelihood ratio of each pair of characters, random against ordinary."""
    p, q = markov_model([*random_samples(), *extra_random]), markov_model([*IDENTIFIERS, *extra_ordinary], 0.2)
    return [[x - y for x, y in zip(a, b)] for a, b in zip(p, q)]


def log_ratio(token: str, ratios: list[list[float]]) -> float:
    """Mean log-likelihood ratio a character; over 0 the random model fits better."""
    at = [_ALPHABET[c] for c in token]
    return sum(ratios[a][b] for a, b in zip([_N, *at], at)) / len(at)


def find_secrets(text: str, ratios: list[list[float]], least: float = -0.3) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each span, by start and then kind, in code points."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    runs = [(m.start(), m.end()) for m in _RUN.finditer(text)]
    for a, b in runs:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
        found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text, a, b)]
    # of the spans that start before a run's end, the furthest end tells whether any meets it
    base = sorted((s, e) for s, e, _ in found)
    starts, ends = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    for a, b in runs:
        token, before = text[a:b].rstrip("="), bisect_left(starts, b)
        if len(token) >= 20 and not (before and ends[before - 1] > a) and log_ratio(token, ratios) >= least:
            found.append((a, b, 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = -0.3, labelled: Sequence[tuple[str, int]] = ()) -> DataFrame:
    """Secrets in every whole text.

    Three patterns (assignments, access keys, long hex runs) give the base spans. The
    rest of the tokens of 20 characters or more of the key alphabet are scored by two first-order Markov models, one of random strings and
    one of ordinary identifiers, trained on labelled samples (``labelled`` adds pairs of
    token and label, 1 for random); a mean log-likelihood ratio of ``least`` or more makes
    a span of kind ``random``. Spans count code points, end exclusive.

    Returns ``id_col``, ``n_assign``, ``n_access``, ``n_hex``, ``n_random``, ``base_sha256``
    (of the base spans written kind:start:end, comma-joined) and ``spans`` (all, likewise;
    empty if none). Null and empty texts have no spans. Null ids and repeated rows are
    kept. Other columns are left out. An empty table gives no rows.
    """
    prepare(df.sparkSession)
    extra = tuple(s for s, y in labelled if y), tuple(s for s, y in labelled if not y)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = _ratios(*extra)
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            shas, spans = [], []
            for text in batch.column(1):
                found = find_secrets(text.as_py(), ratios, least)
                for n, kind in zip(counts, KINDS):
                    n.append(sum(k == kind for *_, k in found))
                written = [(k, f"{k}:{s}:{e}") for s, e, k in found]
                shas.append(hashlib.sha256(",".join(w for k, w in written if k != "random").encode()).hexdigest())
                spans.append(",".join(w for _, w in written))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    out = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(scan, schema)
    return out.withColumnRenamed("id", id_col)
