"""Test tables written as the text that the operators read.

The queries need real log lines, and the tables hold none, so each row becomes one line by a fixed
expression. The matching SQL computes the expected columns from the same raw columns and never
parses a line. Every row of a table is used.

Rendered lines carry the same order columns as scanned ones: a block is a fixed range of keys.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.labels import content_md5
from fleetlens.functions.matching import held
from fleetlens.sources.ranges import create_file

BLOCK_ROWS = 4096


def as_lines(df: DataFrame, file_path: Column, seq: Column, value: Column, *keep: str) -> DataFrame:
    rows = df.select(
        file_path.alias("file_path"),
        F.call_function("div", seq.cast("bigint"), F.lit(BLOCK_ROWS).cast("bigint")).alias("block_start"),
        seq.cast("bigint").alias("seq"),
        *keep,
        value.alias("value"),
    )
    # Held, so that filters on the text do not render it again, as they would not with a scanned line.
    return held(rows, value=F.col("value")).withColumn("n_bytes", F.octet_length("value").cast("bigint") + 1)


def write_images(supplier: DataFrame, folder: str) -> None:
    """A PNG file per supplier, and for every seventh one bytes that are none."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, nation in zip(*(c.to_pylist() for c in batch.columns)):
                data = b"no image" if key % 7 == 0 else _png(key % 50 + 1, nation + 1)
                with create_file(f"{folder}/{key}.png") as out:
                    out.write(data)
            yield batch

    rows = supplier.selectExpr("cast(s_suppkey AS bigint) AS key", "cast(s_nationkey AS bigint) AS nation")
    rows.mapInArrow(write, rows.schema).write.format("noop").mode("overwrite").save()


def _png(width: int, height: int) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = zlib.compress(b"".join(b"\0" + b"\0\0\0" * width for _ in range(height)))
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


def event_ip() -> Column:
    """The address as the SQL writes it; of user 65535 on, the v6 text has a group too long to be an address."""
    return F.expr(
        """CASE WHEN event_id % 13 = 0 THEN concat('2a01::', lower(hex(user_id + 1)))
           ELSE concat('10.', user_id % 4, '.', event_id % 200, '.', user_id % 250) END"""
    )


def event_address() -> Column:
    """The address that ``event_ip`` stands for, in groups of at most four digits."""
    return F.expr(
        """CASE WHEN event_id % 13 = 0
             THEN concat('2a01::', lower(regexp_replace(hex(user_id + 1), '(?!^)(?=(?:.{4})+$)', ':')))
           ELSE concat('10.', user_id % 4, '.', event_id % 200, '.', user_id % 250) END"""
    )


def access_line(closing: Column | None = None) -> Column:
    """One access-log line per row of ``events`` with its ``ip``."""
    ip = F.col("ip")
    peer = (
        F.when(F.expr("event_id % 5 = 0"), F.concat(ip, F.lit(">")))
        .when(F.expr("event_id % 5 = 1"), F.expr("concat('172.16.0.', event_id % 250, '>')"))
        .otherwise("")
    )
    return F.concat(
        peer,
        ip,
        F.expr("CASE WHEN event_id % 3 = 0 THEN ' - ' ELSE concat(' u', user_id, ' ') END"),
        F.expr("CASE WHEN event_id % 4 = 0 THEN '-' ELSE 'TLSv1.3' END"),
        F.lit(" ["),
        F.date_format(F.col("ts"), "dd/MMM/yyyy:HH:mm:ss"),
        F.lit(" +0000"),
        closing if closing is not None else F.lit("]"),
        F.lit(" "),
        access_request(),
        F.expr(
            """CASE event_type WHEN 'click' THEN ' 200 ' WHEN 'view' THEN ' 204 ' WHEN 'purchase'
               THEN ' 302 ' WHEN 'signup' THEN ' 404 ' ELSE ' 500 ' END"""
        ),
        F.expr(
            """CASE WHEN event_id % 19 = 0 THEN '-'
               ELSE cast(cast(round(value * 100) AS bigint) * 500 AS string) END"""
        ),
        F.expr(
            r"""CASE WHEN event_id % 7 = 0 THEN '' ELSE concat(
                  CASE event_id % 3 WHEN 1 THEN ' "-"' WHEN 2 THEN ' ""'
                    ELSE concat(' "https://www.example.org/', event_type, '"') END,
                  CASE WHEN event_id % 23 = 0 THEN ' "agent \\"q\\" x"'
                    ELSE concat(' "Mozilla/5.0 (u', user_id, ')"') END,
                  CASE WHEN event_id % 7 = 1 THEN ''
                    ELSE concat(' ', (event_id * 7919) % 120000000) END) END"""
        ),
    )


def access_request() -> Column:
    return F.expr(
        """concat('"GET /', event_type, CASE WHEN event_id % 2 = 0 THEN concat('?k=', event_id)
           ELSE '' END, CASE WHEN event_id % 17 = 0 THEN ' HTTP/2.0"' ELSE ' HTTP/1.1"' END)"""
    )


def access_lines(events: DataFrame, closing: Column | None = None, ip: Column | None = None) -> DataFrame:
    """One log file per user."""
    return as_lines(
        held(events, ip=event_ip() if ip is None else ip),
        F.concat(F.lit("access/"), F.col("user_id").cast("string")),
        F.col("event_id"),
        access_line(closing),
        "event_id",
    )


def error_line() -> Column:
    """One error-log line per row of ``events``; some are damaged in one of three ways."""
    return F.concat(
        F.lit("["),
        F.date_format("ts", "EEE "),
        F.expr("CASE WHEN event_id % 31 = 30 THEN 'Xyz' ELSE date_format(ts, 'MMM') END"),
        F.date_format("ts", " dd HH:mm:ss.SSSSSS yyyy"),
        F.expr(
            """concat('] [', CASE event_id % 5 WHEN 0 THEN 'ssl' WHEN 1 THEN 'core' WHEN 2 THEN 'php7'
               WHEN 3 THEN '' ELSE 'reqtimeout' END,
               CASE WHEN event_id % 2 = 0 THEN ':info] ' ELSE ':error] ' END,
               CASE WHEN event_id % 37 = 36 THEN '[' ELSE '[pid ' END, 1000 + user_id,
               CASE WHEN event_id % 4 = 0 THEN concat(':tid ', event_id * 31) ELSE '' END, '] ')"""
        ),
        F.when(F.expr("event_id % 3 = 0"), "").otherwise(
            F.concat(
                F.lit("[client "),
                F.when(F.expr("event_id % 29 = 28"), "10.0.0.1").otherwise(
                    F.concat(F.col("ip"), F.expr("concat(':', 1024 + event_id % 60000)"))
                ),
                F.lit("] "),
            )
        ),
        F.expr(
            """CASE event_id % 9 WHEN 0 THEN concat('AH01964: Connection to child ', event_id, ' established')
               WHEN 1 THEN 'AH01998: Connection closed to child' WHEN 2 THEN 'AH01991: SSL input filter'
               WHEN 3 THEN 'AH01993: SSL output filter' WHEN 4 THEN 'AH01382: Request header read timeout'
               WHEN 5 THEN "script '/srv/a.php' not found or unable to stat"
               WHEN 6 THEN 'AH00128: File does not exist: /srv/b'
               WHEN 7 THEN concat('  Notice:  undefined index k', event_id, ' ')
               ELSE 'late AH01382: not at the start' END"""
        ),
    )


def error_lines(events: DataFrame) -> DataFrame:
    """One error log per web server of ten."""
    file_path = F.expr("concat('error/web', user_id % 10)")
    rows = held(events, ip=event_ip())
    return as_lines(rows, file_path, F.col("event_id"), error_line(), "event_id")


def message_id(key: str) -> Column:
    return F.upper(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 10))


# Message texts by kind number; all of the columns they use are held by mail_lines.
MAIL_MESSAGES = (
    """concat('warning: hostname ', h, ' does not resolve to address ', ip,
       CASE WHEN l_linenumber % 2 = 0 THEN ': Name or service not known' ELSE '' END)""",
    "concat('connect from ', h, '[', ip, ']')",
    "concat('warning: unknown[', ip, ']: SASL LOGIN authentication failed: UGFz')",
    "concat('lost connection after AUTH from unknown[', ip, ']')",
    "concat('timeout after DATA from ', h, '[', ip, ']')",
    "concat('disconnect from ', h, '[', ip, '] ehlo=1 commands=', l_linenumber)",
    """concat('Pass; identity=mailfrom; client-ip=', ip, '; helo=', h,
       '; envelope-from=a@example.org; receiver=b@example.net')""",
    "concat('NOQUEUE: reject: RCPT from unknown[', ip, ']: 550 5.7.1 rejected')",
    "concat(id, ': client=', h, '[', ip, '], sasl_method=LOGIN')",
    "concat(id, ': from=<a@example.org>, size=', l_partkey, ', nrcpt=1 (queue active)')",
    """concat(CASE WHEN l_linenumber % 2 = 0 THEN 'auth: passwd-file' ELSE 'auth-worker(9): sql' END,
       '(user', l_suppkey, ',', ip, '): unknown user')""",
    """concat('auth: login(user,', ip,
       '): Request timed out waiting for client to continue authentication (150 secs)')""",
    """concat('auth: login(?,', ip,
       '): Username character disallowed by auth_username_chars: 0x7d (username: }x)')""",
    "concat('statistics: max connection rate ', l_linenumber, '/60s for (smtp:10.0.0.1) at Feb  8')",
    "concat('statistics: max connection count ', l_linenumber, ' for (smtp:10.0.0.1) at Feb  8')",
    "concat('statistics: max cache size ', l_linenumber, ' at Feb  8')",
    "concat('statistics: other text ', l_partkey)",
    "'never seen'",
)
_MESSAGES_PER_STEP = 6


def mail_lines(lineitem: DataFrame) -> DataFrame:
    """One mail log per supplier: all message kinds, other texts, and bad months."""
    rows = held(
        lineitem,
        k=F.expr("(l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 18"),
        h=F.expr("concat('h', l_partkey, '.example.org')"),
        ip=F.expr("concat('10.', l_suppkey % 250, '.', l_partkey % 250, '.', l_linenumber)"),
        id=message_id("l_orderkey"),
        text=F.lit(""),
    )
    for start in range(0, len(MAIL_MESSAGES), _MESSAGES_PER_STEP):
        texts = enumerate(MAIL_MESSAGES[start : start + _MESSAGES_PER_STEP], start)
        branches = " ".join(f"WHEN {kind} THEN {text}" for kind, text in texts)
        rows = held(rows, text=F.expr(f"CASE k {branches} ELSE text END"))
    head = held(
        rows,
        head=F.concat(
            F.when(F.col("k") == 17, "Xxx").otherwise(F.date_format("l_shipdate", "MMM")),
            F.lit(" "),
            F.lpad(F.date_format("l_shipdate", "d"), 2, " "),
            F.expr(
                """concat(' ', lpad(l_suppkey % 24, 2, '0'), ':', lpad(l_partkey % 60, 2, '0'), ':',
                   lpad(l_orderkey % 60, 2, '0'), ' mx', l_suppkey % 50, ' ')"""
            ),
        ),
    )
    process = F.expr(
        """CASE WHEN k BETWEEN 10 AND 12 THEN 'dovecot: '
           WHEN k = 6 THEN concat('policyd-spf(', l_linenumber, '): ')
           ELSE concat('postfix/smtpd[', l_partkey, ']: ') END"""
    )
    return as_lines(
        head,
        F.expr("concat('mail/mx', l_suppkey % 50)"),
        F.col("l_orderkey"),
        F.concat(F.col("head"), process, F.col("text")),
        "l_orderkey",
        "l_linenumber",
    )


def session_line() -> Column:
    """One mail-log line per row of ``events``: message ids with and without a client row."""
    return F.concat(
        F.date_format("ts", "MMM d HH:mm:ss"),
        F.expr("concat(' mx', user_id % 3, ' postfix/smtpd[', user_id, ']: ')"),
        F.when(F.expr("event_type IN ('signup', 'click', 'view')"), message_id("user_id")).otherwise(""),
        F.expr(
            """CASE event_type
               WHEN 'signup' THEN CASE WHEN user_id % 7 = 0 THEN ': no client'
                 ELSE concat(': client=h', user_id, '[10.', event_id % 200, '.0.', user_id % 250, ']') END
               WHEN 'purchase' THEN concat('connect from h', user_id, '[10.0.0.', user_id % 250, ']')
               WHEN 'error' THEN concat('statistics: max cache size ', event_id, ' at Feb  8')
               ELSE concat(': ', event_type, ' ', event_id) END"""
        ),
    )


def session_lines(events: DataFrame) -> DataFrame:
    """One mail log per host of three."""
    file_path = F.expr("concat('mail/mx', user_id % 3)")
    return as_lines(events, file_path, F.col("event_id"), session_line(), "event_id")


def document_files(documents: DataFrame) -> DataFrame:
    """Documents as files of a tree per source, hashed in the pass that reads their text."""
    return held(documents, md5=content_md5(F.col("text"))).select(
        F.col("source").alias("root"),
        F.expr("concat(lang, '/', doc_id, '.txt')").alias("subpath"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("mtime"),
        "md5",
        "doc_id",
    )


def document_lines(documents: DataFrame) -> DataFrame:
    """All documents as one file, in order; each document is one block of it."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "value"))
    return rows.select(
        F.lit("history").alias("file_path"),
        F.col("doc_id").alias("block_start"),
        F.col("pos").cast("bigint").alias("seq"),
        (F.octet_length("value") + 1).cast("bigint").alias("n_bytes"),
        "value",
    )


def page_files(pages: DataFrame) -> DataFrame:
    """Pages as files of a tree per web host."""
    path = F.regexp_replace("url", r"(?d)^[a-z]+://[^/]+/|[?#].*$", "")
    return pages.select(
        F.split("url", "/")[2].alias("root"),
        path.alias("subpath"),
        F.octet_length("html").cast("bigint").alias("size"),
    )


def _with_header(lines: DataFrame, header: str) -> DataFrame:
    """Put a header line before the first line of each file."""
    first = lines.select("file_path").distinct().select(
        "file_path", F.lit(0).cast("bigint").alias("block_start"), F.lit(-1).cast("bigint").alias("seq"),
        F.lit(header).alias("value"),
    )
    return lines.unionByName(first, allowMissingColumns=True)


def disk_lines(supplier: DataFrame) -> DataFrame:
    """Three mounts per supplier: a container (for three of four), its overlay, and a plain one."""
    mounts = supplier.select(
        "s_suppkey",
        F.expr("concat('h', s_nationkey)").alias("host"),
        F.expr("cast(abs(s_acctbal) * 100 AS bigint)").alias("size"),
        F.expr(
            """posexplode(array(
                 CASE WHEN s_suppkey % 4 > 0 THEN concat('/var/lib/docker/containers/',
                   sha2(concat('c', s_suppkey), 256), '/mounts/shm') ELSE concat('/data/', s_suppkey) END,
                 concat('/var/lib/docker/overlay2/', sha2(concat('o', s_suppkey), 256), '/merged'),
                 concat('/srv/', s_suppkey)))"""
        ).alias("n", "mount"),
    )
    value = F.expr(
        """concat('/dev/sd', n, '   ext4   ', size, ' ', size div 2, '  ', size - size div 2, ' 50%   ', mount)"""
    )
    lines = as_lines(mounts, F.col("host"), F.col("s_suppkey") * 3 + F.col("n"), value, "host")
    blank = lines.select("file_path", "host").distinct().select(
        "file_path", "host", F.lit(2**40).alias("block_start"), F.lit(2**52).alias("seq"), F.lit("").alias("value")
    )
    lines = _with_header(lines.unionByName(blank, allowMissingColumns=True),
                         "Filesystem Type 1M-blocks Used Available Use% Mounted on")
    return lines.withColumn("host", F.col("file_path"))


def container_meta(supplier: DataFrame) -> DataFrame:
    """Inspect output of one container per supplier."""
    return supplier.select(
        F.expr("concat('h', s_nationkey)").alias("host"),
        F.expr(
            """concat('[{"Id": "', sha2(concat('c', s_suppkey), 256), '", "Name": "/svc', s_suppkey,
               '", "State": {"Running": true}, "GraphDriver": {"Name": "overlay2", "Data": {"MergedDir": ',
               CASE WHEN s_suppkey % 5 = 0 THEN '"/mnt/other"' ELSE concat('"/var/lib/docker/overlay2/',
                 sha2(concat('o', s_suppkey), 256), '/merged"') END, '}}}, {"Name": "/second"}]')"""
        ).alias("value"),
    )


def container_lines(lineitem: DataFrame) -> DataFrame:
    """One container listing per supplier, with empty, malformed and repeated port groups."""
    value = F.expr(
        """concat(substring(md5(cast(l_orderkey AS string)), 1, 12), '   img', l_partkey, ':1.0   "run it"   ',
             l_linenumber, ' days ago   ',
             CASE l_linenumber WHEN 1 THEN concat('Exited (', l_suppkey % 3, ') 2 days ago') WHEN 2 THEN 'Created'
               WHEN 3 THEN 'Restarting (1) 5 seconds ago' ELSE 'Up 2 hours' END, '   ',
             CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN ':::80->80/tcp   '
               WHEN 7 THEN '0.0.0.0:8000-8001->8000-8001/tcp   '
               ELSE concat('0.0.0.0:', l_partkey, '->80/tcp, 10.', l_suppkey % 250, '.0.1:25->25/tcp, 53/udp, ',
                 '0.0.0.0:443->443/tcp, 10.', l_suppkey % 250, '.0.1:', l_partkey, '->53/udp   ') END,
             CASE WHEN l_linenumber = 6 THEN '' ELSE concat('svc', l_orderkey) END)"""
    )
    key = F.expr("l_orderkey * 16 + l_linenumber")
    file_path = F.expr("concat('ps/', l_suppkey)")
    lines = as_lines(lineitem, file_path, key, value, "l_orderkey", "l_linenumber")
    return _with_header(lines, "CONTAINER ID   IMAGE   COMMAND   CREATED   STATUS   PORTS   NAMES")


def firewall_lines(part: DataFrame, region: DataFrame) -> DataFrame:
    """One listing of two tables: a chain per brand, an empty chain and a stray line per region, and
    a chain ``OUTPUT`` per region with as many rules as its key says, every second one in ``nat``.

    A section starts at ``brand`` or ``1000 + region`` times 2**40; its rules lie in blocks of 256.
    """
    header = "num   pkts bytes target prot opt in out source destination"
    brand = "cast(substring(p_brand, 7) AS bigint)"
    rules = part.selectExpr(
        "'filter' AS table",
        f"{brand} * (1L << 40) + p_partkey + 10 AS seq",
        """concat(p_partkey, '   ', p_size, 'K  ', p_partkey * 3, ' ', element_at(array('REJECT', 'DROP', 'ACCEPT',
             'LOG', 'RETURN', p_type), cast(p_partkey % 6 + 1 AS int)), '  ',
             CASE WHEN p_size % 2 = 0 THEN 'all' ELSE 'tcp' END, '  --  ',
             CASE WHEN p_size % 3 = 0 THEN '!eth0' ELSE '*' END, '  eth', p_size, '   ',
             CASE WHEN p_size % 5 = 0 THEN '0.0.0.0/0' ELSE '!10.0.0.0/8' END, '   0.0.0.0/0   ',
             CASE WHEN p_size % 7 = 0 THEN '' ELSE concat('tcp  dpt:', p_size) END) AS value""",
    )
    brands = part.select(F.expr(f"{brand} * (1L << 40)").alias("at"), "p_brand").distinct()
    frame = brands.select(F.lit("filter").alias("table"), "at", F.expr(
        f"""inline(array(struct(0L AS n, concat('Chain ', p_brand, ' (policy DROP 0 packets, 0 bytes)') AS value),
             struct(1L AS n, '{header}' AS value), struct(1L << 39 AS n, '' AS value)))"""
    ))
    empty = region.select(F.lit("filter").alias("table"), F.expr("(1000L + r_regionkey) * (1L << 40)").alias("at"), F.expr(
        f"""inline(array(struct(0L AS n, concat('Chain ', replace(r_name, ' ', '-'), ' (2 references)') AS value),
             struct(1L AS n, '{header}' AS value), struct(2L AS n, '' AS value),
             struct(3L AS n, concat('stray ', r_name) AS value)))"""
    ))
    output = region.select(
        F.expr("CASE WHEN r_regionkey % 2 = 1 THEN 'nat' ELSE 'filter' END").alias("table"),
        F.expr("(2000L + r_regionkey) * (1L << 40)").alias("at"),
        F.expr(
            f"""posexplode(concat(array('Chain OUTPUT (policy ACCEPT 0 packets, 0 bytes)', '{header}'),
                 transform(filter(sequence(0, cast(r_regionkey AS int)), i -> i > 0),
                   i -> concat(i, ' 0 0 ACCEPT all -- * * 0.0.0.0/0 0.0.0.0/0')), array('')))"""
        ).alias("n", "value"),
    )
    framed = frame.unionByName(empty).unionByName(output).selectExpr("table", "at + n AS seq", "value")
    lines = rules.unionByName(framed)
    block = F.expr("seq div 256")
    return lines.select(F.lit("firewall").alias("file_path"), block.alias("block_start"), "seq", "table", "value")


def account_lines(customer: DataFrame) -> DataFrame:
    value = F.expr(
        """concat(c_name, ':x:', c_custkey, ':', 100 + c_nationkey, ':', c_mktsegment, ':/home/', c_custkey,
             ':', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '/bin/bash' END)"""
    )
    return as_lines(customer, F.lit("passwd"), F.col("c_custkey"), value)


def alias_lines(nation: DataFrame, region: DataFrame) -> DataFrame:
    """An alias per nation, some given again, with comments and text past the end mark."""
    alias = "substring(md5(cast(n_nationkey AS string)), 1, 6)"
    rows = (
        nation.selectExpr("n_nationkey AS seq", f"concat('  ', {alias}, '  ', n_name, ' rest') AS value")
        .union(nation.where("n_regionkey = 1").selectExpr("50 + n_nationkey", f"concat({alias}, ' ', n_name, '_new')"))
        .union(region.selectExpr("-10 - r_regionkey", "concat('; comment ', r_name)"))
        .union(region.selectExpr("-20 - r_regionkey", "''"))
        .union(region.selectExpr("100 + r_regionkey * 2", "'_EOF_'"))
        .union(region.selectExpr("101 + r_regionkey * 2", "concat('00', r_regionkey, ' ignored')"))
    )
    return as_lines(rows, F.lit("aliases"), F.col("seq"), F.col("value"))


def conversation_lines(conversations: DataFrame) -> DataFrame:
    """One mail message per conversation; user turns name the client, unless there is none."""
    value = F.concat(
        F.lit("Feb  8 15:51:20 mx postfix/smtpd[1]: "),
        message_id("conv_id"),
        F.expr(
            """CASE WHEN role = 'user' AND conv_id % 7 > 0
                 THEN concat(': client=', role, '[10.', conv_id % 250, '.', turn, '.0]')
               ELSE concat(': ', octet_length(text), ' bytes') END"""
        ),
    )
    return as_lines(conversations, F.lit("mail/conversations"), F.col("turn"), value, "conv_id", "turn")
