"""Chat formatting with tool-call linking, in DataFrame operations.

Messages (conv_id, turn, role, text) may hold blocks
`<tool_call>{"id", "name", "arguments", "after"}</tool_call>` and
`<tool_result>{"id", "content"}</tool_result>`. Each block and each remaining
text is one part, and one row of the result:

* results are joined with calls on (conv_id, id), a hash join;
* parts are ordered topologically: a result comes after its call, and a call
  after the results of the calls it names in `after`. The order is that of
  (order_rank, turn, part). A rank is the least number, from the part's turn up,
  with which it follows all that it depends on, so parts in order keep their
  turns and cost one check. Conversations with a part out of order are ranked by
  pointer doubling: each part points to the parent that holds it back most, and
  doubling the pointers' reach follows a chain of any length in a number of rounds
  that grows with its logarithm. Pointers that never end circle: the parts that
  they circle through lie on a cycle and are reported so, the links among such
  parts order nothing, and all other parts are ordered as if those links were not
  there;
* arguments are checked against the tools' schemas (a parameter): names, types,
  required ones;
* every part is written as canonical JSON: keys sorted at every level, no blanks.

No conversation is ever gathered in one place, so one that holds a third of all
rows is spread like the others.

Input cases: a null text is an empty text part. Malformed JSON, calls without a
result, results without a call, repeated ids and failing arguments are reported
in `problem`; nothing is dropped. Of calls with one id the first (turn, part)
owns it. Rows that repeat are parts of their own. A null conv_id is a
conversation like others. A null turn counts as turn 0 in the order and stays null
in `turn`. Long texts are parsed whole. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_table
from . import common as C

BLOCK = r"(?s)<tool_(call|result)>(.*?)</tool_\1>"
#: tool: {argument: (JSON type, required)}
SCHEMAS = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}


def split_parts(messages: DataFrame) -> DataFrame:
    """A row per part: conv_id, turn, role, part, kind (text, call, result), body and a row number, stored."""
    text = F.coalesce("text", F.lit(""))
    kinds, bodies = F.regexp_extract_all(text, F.lit(BLOCK), 1), F.regexp_extract_all(text, F.lit(BLOCK), 2)
    rest = F.regexp_replace(text, BLOCK, "")
    blocks = F.transform(F.arrays_zip(kinds.alias("kind"), bodies.alias("body")), lambda x: F.struct(x["kind"].alias("kind"), x["body"].alias("body")))
    words = F.when((F.size(kinds) == 0) | rest.rlike(r"[^\x20\x09-\x0D]"), F.array(F.struct(F.lit("text").alias("kind"), rest.alias("body"))))
    parts = F.concat(F.coalesce(words, F.array().cast("array<struct<kind:string,body:string>>")), blocks)
    rows = messages.select("conv_id", "turn", "role", F.posexplode(parts).alias("part", "p")).select("conv_id", "turn", "role", "part", "p.kind", "p.body")
    return scratch_table(rows.withColumn("row", F.monotonically_increasing_id()), "chat-parts")


def _parsed(parts: DataFrame) -> DataFrame:
    doc = F.when(F.col("kind") != "text", F.try_parse_json("body"))
    get = lambda path, kind: F.try_variant_get("doc", path, kind)
    return parts.withColumn("doc", doc).withColumns({
        "id": get("$.id", "string"), "name": get("$.name", "string"), "arguments": get("$.arguments", "variant"),
        "content": get("$.content", "variant"), "after": get("$.after", "array<string>")})


def _is(kind: str, t: Column) -> Column:
    return {"string": t == "STRING", "integer": t == "BIGINT", "boolean": t == "BOOLEAN",
            "number": (t == "BIGINT") | (t == "DOUBLE") | t.startswith("DECIMAL"),
            "array": t.startswith("ARRAY"), "object": t.startswith("OBJECT")}[kind]


def argument_problems(schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with name and arguments of a call, or null. Checks follow the schemas' order."""
    out = F.lit("unknown tool")
    for tool, schema in schemas.items():
        found = []
        for arg, (kind, required) in schema.items():
            value = F.try_variant_get("arguments", f"$['{arg}']", "variant")
            absent = value.isNull() | F.is_variant_null(value)
            found.append(F.when(absent, F.lit(f"missing argument {arg}") if required else F.lit(None))
                         .when(~_is(kind, F.schema_of_variant(value)), F.lit(f"argument {arg} is not {kind}")))
        names = F.json_object_keys(F.to_json("arguments"))
        found.append(F.when(F.size(F.array_except(names, F.array(*[F.lit(a) for a in schema]).cast("array<string>"))) > 0, "unknown argument"))
        joined = F.concat_ws("; ", *found)
        out = F.when(F.col("name") == tool, F.when(joined != "", joined)).otherwise(out)
    return out


def _ranks(edges: DataFrame) -> DataFrame | None:
    """(row, rank, cycle) of all parts of conversations with a part out of order; None if there is none.

    edges: c (the conversation) and the structs parent and child (turn, part, row).
    """
    behind = (F.col("parent") > F.col("child")).cast("long")  # a parent that stands later must have a smaller rank, others at most an equal one
    late = edges.filter("parent > child").select("c").distinct()
    links = scratch_table(edges.join(late, "c", "left_semi").select("c", "parent", "child", behind.alias("w")), "chat-links")
    nodes = links.select("c", F.explode(F.array("parent", "child")).alias("n")).select("c", "n.row", F.col("n.turn").alias("start")).distinct()
    nodes = scratch_table(nodes, "chat-nodes")
    n = nodes.groupBy("c").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]  # no circle is longer than a conversation
    if not n:
        return None
    links = links.select(F.col("parent.row").alias("parent"), F.col("child.row").alias("child"), "w")
    ranks, circling = nodes.select("row", F.col("start").alias("rank")), nodes.select("row").limit(0)
    while True:
        held = (links.join(ranks, links["parent"] == ranks["row"])
                .groupBy("child").agg(F.max(F.struct((F.col("rank") + F.col("w")).alias("rank"), "parent", "w")).alias("by")))
        # a part's rank is the larger of `own` and the rank of the part at `to`, plus `off`
        reach = nodes.join(held, nodes["row"] == held["child"], "left").select("row", F.col("start").alias("own"), F.col("by.parent").alias("to"), F.col("by.w").alias("off"))
        reach, hops = scratch_table(reach, "chat-reach"), 1
        while hops <= n and reach.filter("to IS NOT NULL").limit(1).count():
            next_ = reach.select(F.col("row").alias("at"), F.col("own").alias("its"), F.col("to").alias("on"), F.col("off").alias("more"))
            further = reach.filter("to IS NOT NULL").join(next_, F.col("to") == F.col("at"), "left").select(
                "row", F.greatest("own", F.col("its") + F.col("off")).alias("own"), F.col("on").alias("to"), (F.col("off") + F.col("more")).alias("off"))
            reach = scratch_table(further.union(reach.filter("to IS NULL")), "chat-reach")
            hops *= 2
        on_cycle = scratch_table(reach.filter("to IS NOT NULL").select(F.col("to").alias("row")).distinct(), "chat-cycle")
        if on_cycle.limit(1).count():  # after more hops than parts a pointer is on a circle
            circling = scratch_table(circling.union(on_cycle).distinct(), "chat-cycles")
            ends = links.join(circling.select(F.col("row").alias("parent"), F.lit(True).alias("p")), "parent", "left").join(
                circling.select(F.col("row").alias("child"), F.lit(True).alias("q")), "child", "left")
            links = scratch_table(ends.filter("p IS NULL OR q IS NULL").select("parent", "child", "w"), "chat-links")
            ranks = nodes.select("row", F.col("start").alias("rank"))
            continue
        found = reach.select("row", F.col("own").alias("rank"))
        side = lambda end: found.select(F.col("row").alias(end), F.col("rank").alias(f"{end}_rank"))
        wrong = links.join(side("parent"), "parent").join(side("child"), "child").filter(F.col("parent_rank") + F.col("w") > F.col("child_rank"))
        if not wrong.limit(1).count():  # no other parent holds a part back more
            return found.join(circling.withColumn("cycle", F.lit(True)), "row", "left").select("row", "rank", F.coalesce("cycle", F.lit(False)).alias("cycle"))
        ranks = found


def format_chat(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """conv_id, order_rank, turn, part, kind, call_id, linked, problem and json of every part of the messages."""
    parts = split_parts(messages)
    parsed = _parsed(parts)
    turn = F.coalesce("turn", F.lit(0)).cast("long")
    place = F.struct(turn.alias("turn"), "part", "row")
    # a null conversation takes part in equalities as an empty text, which no id has
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c")
    named = parsed.filter("kind <> 'text' AND id IS NOT NULL").select(conv, "conv_id", "kind", "id", "turn", "part", "row", "after")
    owner = named.groupBy("c", "id").agg(
        F.min(F.when(F.col("kind") == "call", place)).alias("call"), F.min(F.when(F.col("kind") == "result", place)).alias("result"))
    linked = named.join(owner, ["c", "id"])  # one row per id on the right
    answered = owner.filter("call IS NOT NULL AND result IS NOT NULL").select("c", F.col("call").alias("parent"), F.col("result").alias("child"))
    waits = (linked.filter("kind = 'call' AND call.row = row").select("c", place.alias("child"), F.explode("after").alias("id"))
             .join(owner.filter("call IS NOT NULL"), ["c", "id"]).select("c", F.coalesce("result", "call").alias("parent"), "child"))
    ranks = _ranks(scratch_table(answered.union(waits).filter("parent <> child"), "chat-edges"))
    is_call = F.col("kind") == "call"
    facts = linked.select(
        "row", (F.col("call").isNotNull() & F.col("result").isNotNull() & (F.when(is_call, F.col("call.row")).otherwise(F.col("result.row")) == F.col("row"))).alias("linked"),
        F.when(is_call & (F.col("call.row") != F.col("row")), "repeated id").when(is_call & F.col("result").isNull(), "no result")
        .when(~is_call & F.col("call").isNull(), "no call").when(~is_call & (F.col("result.row") != F.col("row")), "repeated result").alias("link_problem"))
    rows = parsed.join(facts, "row", "left")
    if ranks is None:
        rows = rows.withColumns({"order_rank": turn, "cycle": F.lit(False)})
    else:
        rows = rows.join(ranks, "row", "left").withColumns({"order_rank": F.coalesce("rank", turn), "cycle": F.coalesce("cycle", F.lit(False))})
    own = (F.when(F.col("kind") == "text", F.lit(None)).when(F.col("doc").isNull(), "malformed").when(F.col("id").isNull(), "no id"))
    problem = F.concat_ws("; ", own, "link_problem", F.when(is_call & F.col("doc").isNotNull(), argument_problems(schemas)), F.when(F.col("cycle"), "cycle"))
    raw = F.when((F.col("kind") != "text") & F.col("doc").isNull(), F.col("body"))
    json = (F.when(F.col("kind") == "text", F.to_json(F.struct(F.col("body").alias("content"), "role", F.lit("text").alias("type"))))
            .when(is_call, F.to_json(F.struct("after", "arguments", "id", "name", raw.alias("raw"), "role", F.lit("call").alias("type"))))
            .otherwise(F.to_json(F.struct("content", "id", raw.alias("raw"), "role", F.lit("result").alias("type")))))
    return rows.select("conv_id", "order_rank", "turn", "part", "kind", F.col("id").alias("call_id"), F.coalesce("linked", F.lit(False)).alias("linked"),
                       F.when(problem != "", problem).alias("problem"), json.alias("json"))


def as_tool_turns(conversations: DataFrame) -> DataFrame:
    """Conversations as calls of a tool `reply`: a user turn calls it, the assistant's next turn is the result.

    A call waits for that of the user turn two before. So that links, order and
    checks have something to find, conversations differ by their ids:
    id % 5 = 1: calls wait for the call two turns later instead;
    id % 5 = 2: result and call change places, so that results come first;
    id % 10 = 4: the first call waits for the second as well, which is a cycle;
    id % 3 = 0: a result stands behind a word of text in one row;
    id % 7 = 2: `turn` is given as a text; id % 7 = 5: `prompt` is called `question`.
    Other roles stay texts.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    rule = lambda by, rest: F.coalesce(conv % by == rest, F.lit(False))
    name = lambda t: F.concat_ws("-", conv.cast("string"), t.cast("string"))
    block = lambda kind, body: F.concat(F.lit(f"<tool_{kind}>"), F.replace(F.to_json(body), F.lit("<"), F.lit("\\u003c")), F.lit(f"</tool_{kind}>"))
    later = rule(5, 1) | (rule(10, 4) & (turn < 2))
    after = F.when(later, F.array(name(turn + 2))).when(turn >= 2, F.array(name(turn - 2)))
    arguments = lambda *fields: block("call", F.struct(after.alias("after"), F.struct(*fields).alias("arguments"), name(turn).alias("id"), F.lit("reply").alias("name")))
    prompt = F.col("text")
    call = (F.when(rule(7, 2), arguments(prompt.alias("prompt"), turn.cast("string").alias("turn")))
            .when(rule(7, 5), arguments(prompt.alias("question"), "turn")).otherwise(arguments(prompt.alias("prompt"), "turn")))
    result = block("result", F.struct(F.col("text").alias("content"), name(turn - 1).alias("id")))
    result = F.when(rule(3, 0), F.concat(F.lit("answer "), result)).otherwise(result)
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    moved = F.when(rule(5, 2) & user, turn + 1).when(rule(5, 2) & assistant, turn - 1).otherwise(turn)
    return conversations.select("conv_id", moved.alias("turn"), F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role")).alias("role"),
                                F.when(user, call).when(assistant, result).otherwise(F.col("text")).alias("text"))


def op9_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(as_tool_turns(C.table(spark, sf_dir, "conversations")))


OP9_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'text' END AS kind,
    CASE WHEN conv_id % 5 = 2 AND role = 'user' THEN turn + 1 WHEN conv_id % 5 = 2 AND role = 'assistant' THEN turn - 1 ELSE turn END AS place,
    CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS call_turn,
    CASE WHEN conv_id % 3 = 0 AND role = 'assistant' THEN 1 ELSE 0 END AS part,
    CASE WHEN conv_id % 5 = 1 OR (conv_id % 10 = 4 AND turn < 2) THEN turn + 2 WHEN turn >= 2 THEN turn - 2 END AS waits_for
  FROM conversations
), k AS (
  SELECT c.*, conv_id || '-' || call_turn AS call_id,
    kind <> 'text' AND EXISTS (FROM c AS o WHERE o.kind <> 'text' AND o.kind <> c.kind AND o.conv_id = c.conv_id AND o.call_turn = c.call_turn) AS linked,
    -- on the cycle: the first two calls of such a conversation, if there are two, and their results
    conv_id % 10 = 4 AND kind <> 'text' AND EXISTS (FROM c AS o WHERE o.kind = 'call' AND o.conv_id = c.conv_id AND o.turn < 2)
      AND EXISTS (FROM c AS o WHERE o.kind = 'call' AND o.conv_id = c.conv_id AND o.turn IN (2, 3)) AND call_turn < 4 AS circling
  FROM c
), edges AS (
  SELECT p.conv_id, p.place AS from_place, p.part AS from_part, r.place, r.part
  FROM k p JOIN k r ON p.kind = 'call' AND r.kind = 'result' AND p.conv_id = r.conv_id AND p.call_turn = r.call_turn AND NOT (p.circling AND r.circling)
  UNION ALL
  SELECT p.conv_id, p.place, p.part, w.place, w.part
  FROM k w JOIN k p ON w.kind = 'call' AND p.conv_id = w.conv_id AND p.call_turn = w.waits_for AND p.kind = CASE WHEN p.linked THEN 'result' ELSE 'call' END
    AND NOT (p.circling AND w.circling)
), ranks AS (
  SELECT conv_id, place, part, place AS rank FROM k
  UNION
  SELECT e.conv_id, e.place, e.part, r.rank + CASE WHEN (e.from_place, e.from_part) > (e.place, e.part) THEN 1 ELSE 0 END
  FROM ranks r JOIN edges e ON r.conv_id = e.conv_id AND r.place = e.from_place AND r.part = e.from_part
), f AS (
  SELECT k.*, coalesce((SELECT max(rank) FROM ranks r WHERE r.conv_id = k.conv_id AND r.place = k.place AND r.part = k.part), place, 0) AS order_rank,
    CASE WHEN kind = 'call' AND waits_for IS NOT NULL THEN '"after":["' || conv_id || '-' || waits_for || '"],' ELSE '' END AS after
  FROM k
)
SELECT conv_id, order_rank, place AS turn, CAST(part AS INTEGER) AS part, kind, CASE WHEN kind <> 'text' THEN call_id END AS call_id, linked,
  nullif(concat_ws('; ', CASE WHEN NOT linked AND kind <> 'text' THEN 'no ' || CASE kind WHEN 'call' THEN 'result' ELSE 'call' END END,
    CASE WHEN kind = 'call' AND conv_id % 7 = 2 THEN 'argument turn is not integer' WHEN kind = 'call' AND conv_id % 7 = 5 THEN 'missing argument prompt; unknown argument' END,
    CASE WHEN circling THEN 'cycle' END), '') AS problem,
  CASE kind WHEN 'text' THEN '{"content":' || to_json(text) || ',"role":' || to_json(role) || ',"type":"text"}'
    WHEN 'call' THEN '{' || after || '"arguments":{' || CASE WHEN conv_id % 7 = 5 THEN '"question":' ELSE '"prompt":' END || to_json(text)
      || ',"turn":' || CASE WHEN conv_id % 7 = 2 THEN '"' || turn || '"' ELSE CAST(turn AS VARCHAR) END || '},"id":"' || call_id || '","name":"reply","role":"assistant","type":"call"}'
    ELSE '{"content":' || to_json(text) || ',"id":"' || call_id || '","role":"tool","type":"result"}' END AS json
FROM f
UNION ALL
SELECT conv_id, coalesce(place, 0), place, 0, 'text', NULL, false, NULL, '{"content":"answer ","role":"tool","type":"text"}' FROM k WHERE part = 1
"""
