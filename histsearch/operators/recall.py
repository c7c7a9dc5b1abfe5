"""The search of the whole history, as one call, and the browsing calls beside it.

Filters, matching, ranking, grouping and top-k are one lazy plan; the driver gets the
page of results (at most 50 rows) and counts.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import recency
from ..functions.text import parse_query, smart_snippet
from ..sources.model import History
from ..sources.written import discard, materialize
from . import browse, diagnose, filters, scan
from .expand import expand
from .options import ArgumentError, Limits, SearchOptions, coerce_bool, coerce_enum, coerce_int, optional_string, search_options
from .rank import CANDIDATES, in_rank_order, rank, texts_of
from .shape import directory_order, group_by_session, struct_order, top_diverse


@dataclass
class Engine:
    """A history with the caller's place in it. ``now_ms`` stands for the clock."""

    history: History
    now_ms: int
    limits: Limits = Limits()
    session_id: str | None = None
    project_id: str | None = None
    worktree: str | None = None
    global_allowed: bool = True
    budget: bool = False

    # Search

    def recall(self, **args) -> dict:
        try:
            return self._recall(search_options(args, self.limits, self.now_ms))
        except ArgumentError as wrong:
            return {"ok": False, "error": str(wrong)}

    def recall_json(self, **args) -> str:
        return json.dumps(self.recall(**args), default=str)

    def discovered(self, o: SearchOptions) -> DataFrame:
        """Sessions of the scope, before directory and count limits."""
        own = o.session_id or (self.session_id if o.scope == "session" else None)
        found = filters.in_scope(self.history.sessions, o.scope, self.project_id, own)
        if own:
            return found
        found = filters.titled(found, o.title)
        if o.directory and o.fallback and o.scope == "project" and self.global_allowed:
            found = filters.dedupe_sessions(found.unionByName(filters.titled(self.history.sessions, o.title)))
        cap = self.limits.max_sessions if o.directory else o.sessions or self.limits.max_sessions
        return found if cap is None else found.orderBy("session_ord", "session_id").limit(cap)

    def targets(self, o: SearchOptions) -> tuple[DataFrame, dict]:
        """The sessions to search, in buckets, and the account of them."""
        if o.scope == "global" and not o.session_id and not self.global_allowed:
            raise ArgumentError("Searches of all projects are switched off")
        found = self.discovered(o)
        n_found = found.count()
        kept = filters.with_buckets(found, o.directory, self.worktree, o.fallback)
        skipped: dict[str, int] = {}
        buckets = None
        n = n_found
        if o.directory:
            o.limit_reason("directory")
            counts = {r[0]: r[1] for r in kept.groupBy("directory_relevance").count().collect()}
            buckets = [b for b in filters.BUCKETS if counts.get(b)]
            n = sum(counts.values())
            if o.fallback and not (self.worktree or "").strip():
                o.warnings.append("No worktree is known, so no bucket of the project stands between the directory and the rest.")
            if o.fallback and set(buckets) - {"exact"}:
                o.warnings.append("Sessions outside the directory were searched too, behind its own.")
            if n < n_found:
                skipped["directory"] = n_found - n
        eligible = n
        if o.sessions is not None and eligible > o.sessions:
            skipped["sessionsLimit"] = eligible - o.sessions
            o.limit_reason("sessionsLimit")
            kept, n = filters.first_sessions(kept, o.sessions), o.sessions
        if self.limits.max_sessions is not None and n_found >= self.limits.max_sessions:
            o.limit_reason("maxSessions")
        if o.title:
            o.limit_reason("title")
        if o.session_id:
            o.limit_reason("sessionID")
        elif o.scope != "global":
            o.limit_reason("scope")
        account = {"total_sessions_known": False, "sessions_discovered": n_found, "sessions_eligible": eligible, "sessions_searched": n, "sessions_skipped": n_found - n}
        if skipped:
            account["skipped_by_reason"] = skipped
        if buckets is not None:
            account["directory_buckets_searched"] = buckets
        return kept, account

    def hits(self, o: SearchOptions, targets: DataFrame, match: str | None = None) -> DataFrame:
        match = match or o.match
        where = {"kind": o.type, "role": o.role, "tool_name": o.tool_name, "after": o.after, "before": o.before}
        if match == "literal":
            return scan.literal_scan(self.history, targets, o.query, o.width, **where)
        if match == "regex":
            return scan.regex_scan(self.history, targets, o.query, o.width, **where)
        return rank(self.history, targets, parse_query(o.query), match, self.now_ms, self.budget, o.explain, **where)

    def _page(self, o: SearchOptions, hits: DataFrame, ranked: bool) -> tuple[list[dict], int]:
        """(results, total): the first groups or hits, and how many there are. Hits of a scan are
        narrow rows, written once for the counts and the page; ranked ones are written already."""
        order = in_rank_order() if ranked else scan.in_scan_order()
        by_directory = bool(o.directory and o.fallback)
        hits = hits if ranked else materialize(hits, "hits")
        if o.group == "session":
            grouped = group_by_session(hits, struct_order(order))
            place = [F.col("first_place")]
            final = grouped.orderBy(*(directory_order(place) if by_directory else place)).limit(o.results)
            total = hits.select("session_id").distinct().count()
        else:
            n, total = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum("hit_fields"), F.lit(0))).first()
            final = top_diverse(hits, order, o.results, by_directory, total=n)
        final = final.withColumn("recency", recency(F.col("time"), self.now_ms))
        rows = [r.asDict(recursive=True) for r in final.collect()]
        if ranked:
            texts = texts_of(self.history, rows)
            rows = [r | {"raw": texts.get((r["session_id"], r["part_id"]), "")} for r in rows]
        else:
            discard(hits)
        return rows, total

    def _shown(self, o: SearchOptions, row: dict, match: str, reported: str | None) -> dict:
        out = {k: row[k] for k in ("session_id", "session_title", "directory", "message_id", "role", "time", "part_id", "part_type", "pruned", "snippet", "source", "directory_relevance")}
        if match in ("smart", "fuzzy"):
            out["snippet"] = smart_snippet(row["raw"], parse_query(o.query), o.width)
            out |= {"score": row["score"], "matched_terms": row["matched_terms"]}
            if o.explain and row["match_reasons"]:
                out["match_reasons"] = row["match_reasons"]
        if reported:
            out["match_mode"] = reported
        for name in ("tool_name", "hit_count", "title_match"):
            if row.get(name) is not None:
                out[name] = row[name]
        fields = row["matched_fields"] or {"title": ["title"], "tool": [], "reasoning": ["reasoning"]}.get(row["source"], ["text"])
        out["why"] = {
            "matched_fields": fields, "matched_terms": row["matched_terms"], "directory_relevance": row["directory_relevance"], "recency": row["recency"],
            "confidence": "medium" if row["source"] == "title" else "high",
        }
        return out

    def _recall(self, o: SearchOptions) -> dict:
        if o.match == "regex":
            scan.check_pattern(self.history.sessions.sparkSession, o.query)
        targets, account = self.targets(o)
        where = {"kind": o.type, "role": o.role, "tool_name": o.tool_name, "after": o.after, "before": o.before}
        counts = diagnose.coverage_counts(self.history, targets, **where).first()
        failed = diagnose.load_errors(self.history, targets)
        n_failed = failed.count()
        if n_failed:
            o.limit_reason("loadError")

        match, degrade = o.match, None
        rows, total = self._page(o, self.hits(o, targets), match in ("smart", "fuzzy"))
        if match in ("smart", "fuzzy"):
            degrade = "budget" if self.budget and counts["parts_searched"] >= CANDIDATES else "none"
            if degrade == "budget":
                o.limit_reason("rankingBudget")
            if not rows:
                again, n_again = self._page(o, self.hits(o, targets, "literal"), False)
                if again:
                    rows, total, match, degrade = again, n_again, "literal", "fallback"
        reported = match if o.match != "literal" else None
        results = [self._shown(o, r, match, reported) for r in rows]
        expanded, more = expand(self.history, results, o.expand, o.expand_results, o.window, o.budget_messages, o.budget_chars)

        coverage = account | {"messages_searched": counts["messages_searched"], "parts_searched": counts["parts_searched"]}
        if o.limited_by:
            coverage["limited_by"] = list(o.limited_by)
        buckets: dict[str, int] = {}
        for r in results:
            if r["directory_relevance"] != "unknown":
                buckets[r["directory_relevance"]] = buckets.get(r["directory_relevance"], 0) + 1
        if buckets:
            coverage["directory_bucket_counts"] = buckets
        out = {"ok": True, "results": results, "scanned": account["sessions_searched"], "total": total, "truncated": total > len(results), "group": o.group, "coverage": coverage}
        if reported:
            out["match_mode"] = reported
        if degrade:
            out["degrade_kind"] = degrade
        if n_failed:
            samples = failed.orderBy("session_ord").limit(diagnose.LOAD_ERROR_SAMPLES).select("session_id").collect()
            out |= {"load_error_count": n_failed, "load_errors": [f"{r[0]}: no messages returned" for r in samples]}
        if expanded:
            out["expanded"] = expanded
        warnings = diagnose.cap_warnings(o.warnings + more)
        if warnings:
            out["warnings"] = warnings
        hints = diagnose.suggestions(
            len(results), all(r["source"] == "title" for r in results), account["sessions_searched"], o.query, match, o.type, o.directory, o.fallback
        )
        if hints:
            out["suggestions"] = hints
        if not results:
            misses = [r.asDict() for r in diagnose.near_misses(targets).collect()]
            if misses:
                out["near_misses"] = misses
        return out

    # Browsing

    def _about(self, session_id: str) -> dict:
        row = self.history.sessions.where(F.col("session_id") == session_id).select("title", "directory").first()
        return {"session_title": row["title"] if row else None, "directory": row["directory"] if row else None}

    @staticmethod
    def _item(row: dict) -> dict:
        return {"message": {k: row[k] for k in ("message_id", "role", "time_created", "agent", "model_id")}, "parts": row["parts"]}

    def sessions(self, scope="project", search=None, limit=None) -> dict:
        scope = coerce_enum(scope, ("project", "global"), "project")
        top = self.limits.max_session_list
        if scope == "global" and not self.global_allowed:
            return {"ok": False, "error": "Searches of all projects are switched off"}
        listed = browse.list_sessions(self.history, scope, self.project_id, optional_string(search), coerce_int(limit, min(20, top), 1, top))
        items = [r.asDict(recursive=True) for r in listed.drop("session_ord").collect()]
        return {"ok": True, "sessions": items, "returned": len(items), "scope": scope}

    def messages(self, session_id=None, offset=0, limit=None, role="all", reverse=False, query=None) -> dict:
        sid = optional_string(session_id) or self.session_id
        top = self.limits.max_messages
        offset, limit = coerce_int(offset, 0, 0, None), coerce_int(limit, min(10, top), 1, top)
        role, reverse, query = coerce_enum(role, ("user", "assistant", "all"), "all"), coerce_bool(reverse, False), optional_string(query)
        if self.history.messages.where(F.col("session_id") == sid).isEmpty():
            return {"ok": False, "error": "No messages returned"}
        rows = [r.asDict(recursive=True) for r in browse.messages_page(self.history, sid, offset, limit, role, reverse, query).collect()]
        total = rows[0]["total"] if rows else browse.session_messages(self.history, sid, role, query).count()
        page = {"offset": offset, "returned": len(rows), "total": total, "has_more": offset + limit < total}
        return {"ok": True, "messages": [self._item(r) for r in rows], "context": self._about(sid), "pagination": page}

    def get(self, session_id: str, message_id: str) -> dict:
        row = browse.get_message(self.history, session_id, message_id).first()
        if row is None:
            return {"ok": False, "error": f"Message not found: {message_id}"}
        return {"ok": True} | self._item(row.asDict(recursive=True)) | {"context": self._about(session_id)}

    def context(self, session_id: str, message_id: str, window=None, before=None, after=None) -> dict:
        top = self.limits.max_window
        window = coerce_int(window, min(3, top), 0, top)
        before, after = coerce_int(before, window, 0, top), coerce_int(after, window, 0, top)
        rows = [r.asDict(recursive=True) for r in browse.context_window(self.history, session_id, message_id, before, after).collect()]
        if not rows:
            return {"ok": False, "error": f"Message not found: {message_id}"}
        items = [self._item(r) | {"center": r["center"]} for r in rows]
        return {"ok": True, "messages": items, "context": self._about(session_id), "has_more_before": rows[0]["has_more_before"], "has_more_after": rows[0]["has_more_after"]}
