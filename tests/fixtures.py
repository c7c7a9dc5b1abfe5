"""Small histories for the tests, on a fixed clock."""

import json

from histsearch.operators.recall import Engine
from histsearch.sources.model import MESSAGES, PARTS, SESSIONS, History

NOW = 1_700_000_000_000
PROJECT, OTHER = "/workspace/project", "/workspace/other"


def table(spark, schema, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


class Builder:
    def __init__(self):
        self.s, self.m, self.p = [], [], []

    def session(self, sid, title, directory=PROJECT, ago=1000, project="project-main", archived=None):
        self.s.append(
            {
                "session_id": sid, "session_ord": len(self.s), "project_id": project, "project_name": project, "project_worktree": directory, "directory": directory, "title": title,
                "time_created": NOW - ago - 1000, "time_updated": NOW - ago, "time_archived": archived,
            }
        )

    def message(self, sid, mid, role, ago, *parts):
        order = sum(m["session_id"] == sid for m in self.m)
        self.m.append({"session_id": sid, "message_id": mid, "msg_ord": order, "role": role, "time_created": NOW - ago, "agent": "build", "model_id": "model"})
        for k, part in enumerate(parts):
            pid = mid.replace("m-", "p-", 1) if mid.startswith("m-") else mid + "p"
            self.p.append({"session_id": sid, "message_id": mid, "part_id": pid if k == 0 else f"{pid}-{k}", "part_ord": k} | part)

    def history(self, spark):
        return History(table(spark, SESSIONS, self.s), table(spark, MESSAGES, self.m), table(spark, PARTS, self.p))

    def engine(self, spark, **place):
        return Engine(self.history(spark), NOW, **({"session_id": "s-current", "project_id": "project-main", "worktree": PROJECT} | place))


def text(value):
    return {"part_type": "text", "text": value}


def reasoning(value):
    return {"part_type": "reasoning", "text": value}


def tool(name="bash", status="completed", given=None, output=None, title=None, error=None, compacted=None):
    return {
        "part_type": "tool", "tool": name, "tool_status": status, "tool_input": None if given is None else json.dumps(given, separators=(",", ":")), "tool_output": output,
        "tool_title": (title or name) if status == "completed" else None, "tool_error": error, "compacted": compacted,
    }


#: The sessions and texts of the base fixture.
def base() -> Builder:
    b = Builder()
    b.session("s-other", "Harborview Walkthrough", OTHER, 500, "project-other")
    b.session("s-current", "Current Debugging Session", PROJECT, 1000)
    b.session("s-project-2", "Checkout Cache Investigation", PROJECT, 2000, archived=NOW - 500)
    b.message("s-current", "m-current-1", "user", 90000, text("Original requirement: implement rate-limit middleware for checkout. C++ parser support matters."))
    b.message("s-current", "m-current-2", "assistant", 80000, reasoning("Inspect rateLimitCache before writing tests for checkout behavior."))
    b.message("s-current", "m-current-3", "assistant", 70000, tool(given={"command": "npm test"}, output="Error: Unauthorized while loading session messages", title="Run test suite", compacted=NOW - 65000))
    b.message("s-current", "m-current-4", "assistant", 60000, tool("recall", given={"query": "unique self noise"}, output="unique-self-recall-result should never appear in recall results"))
    b.message("s-current", "m-current-5", "assistant", 50000, {"part_type": "subtask", "description": "Investigate migrations", "prompt": "Check pending database migration cleanup"})
    b.message("s-current", "m-current-6", "assistant", 40000, tool(status="running", given={"command": "pnpm migrate status"}))
    b.message("s-project-2", "m-project-1", "user", 85000, text("Please debug rateLimit cache behavior in checkout."))
    b.message("s-project-2", "m-project-2", "assistant", 30000, tool(status="error", given={"path": "cache"}, error="permission denied when reading checkout cache"))
    b.message("s-project-2", "m-project-3", "assistant", 20000, tool(status="pending", given={"query": "pending migration"}))
    b.message("s-other", "m-other-1", "user", 75000, text("Plan walkthrough pages for demo.harborview.test."))
    b.message("s-other", "m-other-2", "assistant", 65000, text("Use website content pages for the Harborview walkthrough."))
    return b


#: Fixed values from here on: the evaluation corpus (its boilerplate, texts, titles and ages) and its cases.
FILLER = (
    "error failed session message config result typescript src tool output update "
    "function const return import export test build run check log value data type"
)


def corpus() -> Builder:
    b = Builder()
    filler = lambda n: " ".join([FILLER] * n)
    b.session("e-noise", "General refactoring", PROJECT, 5000)
    b.session("e-auth", "OAuth redirect loop fix", PROJECT, 10000)
    b.session("e-rate", "Rate limit middleware", PROJECT, 20000)
    b.session("e-db", "Postgres migration decision", PROJECT, 30000)
    b.session("e-other", "Deploy pipeline", OTHER, 40000, "project-other")
    b.message("e-auth", "ea-1", "user", 100000, text("The login callback keeps looping after the OAuth provider redirect. We need to fix the ECONNREFUSED retry on the token endpoint."))
    b.message("e-auth", "ea-2", "assistant", 99000, reasoning("The redirect loop happens because the state cookie is dropped. Resolved login callback loop after OAuth provider redirect by setting SameSite=Lax."))
    b.message("e-auth", "ea-3", "assistant", 98000, tool(given={"command": "npm run build"}, title="Build output", output=f"{filler(40)} redirect {filler(40)}"))
    b.message("e-rate", "er-1", "user", 90000, text("Implement rate limit middleware for the checkout API using a token bucket."))
    b.message("e-rate", "er-2", "assistant", 89000, tool(given={"command": "npm test"}, title="Test run", output=f"{filler(30)} rate limit middleware token {filler(60)}"))
    b.message("e-rate", "er-3", "assistant", 88000, reasoning("Chose a token bucket rate limiter over a sliding window for the checkout middleware."))
    b.message("e-db", "ed-1", "user", 80000, text("Should we use Postgres or DynamoDB for the ledger?"))
    b.message("e-db", "ed-2", "assistant", 79000, reasoning("We chose Postgres over DynamoDB because the ledger needs multi-row transactions."))
    b.message("e-noise", "en-1", "assistant", 50000, tool(given={"command": "npm run lint"}, title="Lint", output=filler(80)))
    b.message("e-noise", "en-2", "assistant", 1000, text("Minor cleanup; touched the rate variable name."))
    b.message("e-other", "eo-1", "assistant", 70000, tool(status="error", given={"command": "kubectl apply -f deploy.yaml"}, error="permission denied: cannot create resource configmaps in namespace prod"))
    return b


CASES = (
    ("ECONNREFUSED", "smart", "e-auth"),
    ("chose postgres over dynamodb", "smart", "e-db"),
    ("rate limit middleware token bucket", "smart", "e-rate"),
    ('"token bucket" checkout', "smart", "e-rate"),
    ("postgers migration", "fuzzy", "e-db"),
    ("permission denied configmaps namespace", "smart", "e-other"),
    ("rate limiter checkout", "smart", "e-rate"),
    ("oauth redirect loop login callback", "smart", "e-auth"),
)
