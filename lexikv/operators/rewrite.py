"""Rewrite host commands to the engine's own, as column expressions over a command log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexikv.config import Config

# Host command names and the engine's commands.
STRING_COMMANDS = {
    "GET": "get", "SET": "set", "MGET": "mget", "MSET": "mset", "GETEX": "getex", "SETEX": "setex", "SETNX": "setnx", "PSETEX": "psetex",
    "GETDEL": "getdel", "GETSET": "getset", "MSETNX": "msetnx", "STRLEN": "strlen", "APPEND": "append", "SUBSTR": "getrange", "GETRANGE": "getrange", "SETRANGE": "setrange",
}
HASH_COMMANDS = {
    "HGET": "hget", "HMGET": "hmget", "HSET": "hset", "HMSET": "hset", "HSETNX": "hsetnx", "HSETEX": "hsetex", "HGETEX": "hgetex",
    "HVALS": "hvals", "HGETALL": "hgetall", "HSTRLEN": "hstrlen", "HRANDFIELD": "hrandfield", "HGETDEL": "hgetdel",
}
ASYNC = {"mget": "mgetasync", "mset": "msetasync", "hmget": "hmgetasync", "hset": "hsetasync"}
_NEEDS_FIELD_EXPIRY = {"HSETEX", "HGETEX"}


def rewrite(cmd: Column, argc: Column | int, key: Column, config: Config, meta_prefix: str = "dict:", field_expiry: bool = True) -> Column:
    """The engine's command for a host command, else ``cmd`` itself.

    Names match in any case; commands without arguments, keys that start with
    ``meta_prefix`` and families that aren't switched on are left alone.
    ``field_expiry``: the host knows field expiry commands.
    """
    names = (STRING_COMMANDS if config.enable_string_filter else {}) | ({k: v for k, v in HASH_COMMANDS.items() if field_expiry or k not in _NEEDS_FIELD_EXPIRY} if config.enable_hash_filter else {})
    if not names:
        return cmd
    to = {k: ASYNC.get(v, v) if config.enable_async_cmd else v for k, v in names.items()}
    found = F.element_at(F.create_map(*(F.lit(x) for pair in to.items() for x in pair)), F.upper(cmd))
    many = F.lit(argc) if isinstance(argc, int) else argc
    return F.when((many > 1) & ~F.coalesce(F.startswith(key, F.lit(meta_prefix)), F.lit(False)), F.coalesce(found, cmd)).otherwise(cmd)


def dictionary_load(cmd: Column, args: Column, key: Column, role: Column, meta_prefix: str = "dict:") -> Column:
    """``lm`` or ``ld`` where a replica gets a published dictionary, else null.

    That is an HSET of six arguments in all, with fields file_name and data,
    on a key with the prefix in any case; ``:mf`` at its end marks a manifest.
    """
    lower = F.lower(key)
    fields = F.transform(F.array(F.get(args, F.lit(1)), F.get(args, F.lit(3))), F.lower)
    right = (F.upper(cmd) == "HSET") & (role != "master") & F.startswith(lower, F.lit(meta_prefix)) & (F.size(args) == 5) & F.array_contains(fields, "file_name") & F.array_contains(fields, "data")
    return F.when(right, F.when(F.endswith(lower, F.lit(":mf")), "lm").otherwise("ld"))


def may_compress(origin: Column, role: Column) -> Column:
    """Whether a write is encoded: client writes on a master; replicated and replayed ones stay verbatim."""
    return (origin == "client") & (role == "master")
