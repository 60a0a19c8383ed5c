"""Operator 4: chat formatting by tool-call linking (DataFrame functions only).

Calls and results of a conversation are joined by their identifier. A call's arguments are held against its tool's schema
(fields with a type, required or not; no others), and every message is written as canonical JSON: names in order, no white
space, numbers in one form. Messages are put in topological order: a result comes after its call, and a call after the
results of the calls that it names in `after`. place is a message's turn if that order holds already, else the least place
that is later than all it needs; order by place, then turn.

Scale: everything is keyed by conversation and identifier; both sides of a join have one row a key (grouped with partial
sums first), so repeated identifiers make no pairs, and keys that recur in a third of the rows are split by Spark. No
conversation is collected: each message stays a row. Only conversations in which some message stands before what it needs are
ordered, by pointer doubling: in a round every need of a message that itself needs one other (or none) is replaced by
what that one needs, and the steps between are kept, so a chain of n messages takes about log2(n) rounds, whatever its
conversation's size; only messages that are not settled go into the next round. Rounds grow beyond that only with chains of messages that each keep several different needs.

Defined cases: a call without a result, a result without a call, a repeated identifier, an unknown tool, arguments that are no
object, a needed call that is absent, and a cycle are problems listed by name (valid is then false; in a cycle place is the
turn); null texts are left out of the JSON; null conversation ids are one conversation; a call or result without an identifier
links to nothing; messages other than calls and results keep their turn; repeated rows are kept; empty tables give an
empty result; columns other than those named are ignored; texts may be of any length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlake.llm.shared import cut, literal_rows, small, table

#: The JSON types of schemas, as patterns of Spark's names for variant types.
TYPES = {"string": "STRING", "integer": "BIGINT|DECIMAL\\([0-9]+,0\\)", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}
#: The query's tool: field, type, required.
ANSWER = (("answer", "prompt", "string", True), ("answer", "turn", "integer", True), ("answer", "max_words", "integer", False))


def _spread(key):
    """A join key for rows that may have none: instead of null, which all meet in one task, a value of their own that no key equals."""
    return F.coalesce(key, F.concat(F.lit("-"), F.xxhash64("conv_id", "turn", "json").cast("string")))


def _key(conversation, identifier):
    return F.when(identifier.isNotNull(), F.to_json(F.struct(conversation.alias("c"), identifier.alias("i"))))


def _checked(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """messages with json and faults (of a call's arguments)."""
    fits = F.lit(None).cast("string")
    for name, pattern in TYPES.items():
        fits = F.when(F.col("type") == name, F.lit(f"^({pattern})$")).otherwise(fits)
    # a tool's definition is one row: its fields
    tools = schemas.dropDuplicates(["name", "field"]).groupBy(F.col("name").alias("tool")).agg(
        F.map_from_entries(F.collect_list(F.struct("field", F.coalesce(fits, F.lit("^.*$"))))).alias("fields"),
        F.collect_list(F.when(F.col("required"), F.col("field"))).alias("required"),
    )
    parsed = F.try_parse_json("arguments")
    typed = F.from_json(F.when(parsed.isNotNull(), F.col("arguments")), "map<string,variant>")
    out = messages.join(small(tools, tools.count()), F.col("name") == F.col("tool"), "left").withColumn("typed", typed)
    missing = F.transform(F.filter("required", lambda f: ~F.coalesce(F.map_contains_key("typed", f), F.lit(False))), lambda f: F.concat(F.lit("missing: "), f))
    of = lambda e: F.try_element_at("fields", e["key"])
    unknown = F.transform(F.filter(F.map_entries("typed"), lambda e: of(e).isNull()), lambda e: F.concat(F.lit("not in the schema: "), e["key"]))
    wrong = F.transform(F.filter(F.map_entries("typed"), lambda e: ~F.rlike(F.schema_of_variant(e["value"]), of(e))), lambda e: F.concat(F.lit("type: "), e["key"]))
    faults = F.when(F.col("tool").isNull(), F.array(F.lit("unknown tool"))).when(F.col("typed").isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.concat(missing, unknown, wrong))
    arguments = F.coalesce(parsed, F.col("arguments").cast("variant"))
    call = F.to_json(F.struct(arguments.alias("arguments"), F.col("call_id").alias("id"), "name", F.lit("assistant").alias("role"), F.lit("tool_call").alias("type")))
    result = F.to_json(F.struct(F.col("text").alias("content"), F.col("call_id").alias("id"), F.lit("tool").alias("role"), F.lit("tool_result").alias("type")))
    plain = F.to_json(F.struct(F.col("text").alias("content"), "role"))
    kind = F.col("kind")
    out = out.withColumn("json", F.when(kind == "call", call).when(kind == "result", result).otherwise(plain))
    return out.withColumn("faults", F.when(kind == "call", faults).otherwise(F.array().cast("array<string>"))).drop("typed", "fields", "required", "tool")


def _places(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: conversation, node, turn. edges: conversation, node, needs (both known). node, place (null in or behind a cycle) of nodes that don't keep their turn."""
    turns = nodes.select(F.col("node").alias("of"), F.col("turn").alias("needed"))
    early = edges.join(turns, edges["needs"] == turns["of"]).join(nodes.select("node", "turn"), "node").where("needed >= turn")
    wrong = cut(early.select(F.col("conversation").alias("in")).distinct(), "chat-disordered")
    n = wrong.count()
    if not n:
        return nodes.select("node", F.col("turn").alias("place")).limit(0)
    within = lambda rows: rows.join(small(wrong, n), F.col("conversation").eqNullSafe(F.col("in")), "left_semi")
    sizes = within(nodes).groupBy("conversation").agg(F.count("*").alias("size")).select(F.col("conversation").alias("in"), "size")
    sized = within(nodes).join(small(sizes, n), F.col("conversation").eqNullSafe(F.col("in")))
    # place: the latest that is known of it; size: more steps than it has nodes go through a cycle
    held = cut(sized.select("node", F.col("turn").alias("place"), "size", F.lit(False).alias("cyclic")), "chat-nodes")
    links = cut(within(edges).select("node", "needs").distinct().withColumn("steps", F.lit(1).cast("long")), "chat-links")
    n_links, settled = links.count(), []
    while n_links:
        out = links.groupBy("node").agg(F.count("*").alias("n"), F.first("needs").alias("next"), F.first("steps").alias("far"))
        known = held.join(out, "node", "left").select(F.col("node").alias("needed"), F.col("place").alias("at"), F.col("cyclic").alias("bad"), "n", "next", "far")
        met = links.join(known, F.col("needs") == F.col("needed")).join(held.select("node", "size"), "node")
        one = F.col("n") == 1
        met = met.select(
            "node",
            F.when(F.col("n").isNull(), F.lit(None)).when(one, F.col("next")).otherwise(F.col("needs")).alias("needs"),
            F.when(one, F.col("steps") + F.col("far")).otherwise(F.col("steps")).alias("steps"),
            (F.col("at") + F.col("steps")).alias("least"),
            "bad",
            "size",
        )
        met = cut(met.withColumn("bad", F.col("bad") | (F.col("steps") > F.col("size"))), "chat-met")
        new = met.groupBy("node").agg(F.max("least").alias("least"), F.max("bad").alias("bad"))
        after = met.where("needs is not null").join(new.where("bad").select("node"), "node", "left_anti")
        after = cut(after.groupBy("node", "needs").agg(F.max("steps").alias("steps")), "chat-links")
        same = links.join(after.withColumnRenamed("steps", "now"), ["node", "needs"]).where("steps = now").count()
        going = after.select(F.explode(F.array("node", "needs")).alias("node")).distinct().withColumn("going", F.lit(True))
        placed = held.join(new, "node", "left").join(going, "node", "left")
        placed = placed.select("node", F.greatest("place", F.coalesce("least", "place")).alias("place"), "size", (F.col("cyclic") | F.coalesce("bad", F.lit(False))).alias("cyclic"), F.coalesce("going", F.lit(False)).alias("going"))
        placed = cut(placed, "chat-nodes")
        # what has no links left, and isn't needed, goes into no further round
        settled.append(placed.where("not going").drop("going"))
        held = placed.where("going").drop("going")
        if same == n_links:
            # all that is left needs several, each of which needs several: no end is ever reached
            stuck = links.select("node").distinct().withColumn("stuck", F.lit(True))
            held = held.join(stuck, "node", "left").select("node", "place", "size", (F.col("cyclic") | F.col("stuck").isNotNull()).alias("cyclic"))
            break
        links, n_links = after, after.count()
    every = reduce(DataFrame.unionByName, settled, held)
    return every.select("node", F.when(~F.col("cyclic"), F.col("place")).alias("place"))


def link_tool_calls(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, turn, kind, call_id, linked, valid, problems, place, json of every message.

    messages: conv_id, turn, kind (call, result or another), role, call_id, name, arguments (JSON text), after (array of
    call ids), text. schemas: name (of a tool), field, type, required.
    """
    key = _key(F.col("conv_id"), F.col("call_id"))
    checked = cut(_checked(messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "kind", "role", "call_id", "name", "arguments", "after", "text"), schemas).withColumn("k", key).select("conv_id", "turn", "kind", "call_id", "after", "json", "faults", "k"), "chat-messages")
    ends = checked.where("k is not null")
    side = lambda kind: ends.where(F.col("kind") == kind).groupBy(F.col("k").alias(f"{kind}_k")).agg(F.first("conv_id").alias(f"{kind}_conv"), F.min("turn").alias(f"{kind}_turn"), F.count("*").alias(f"{kind}_n"))
    pairs = side("call").join(side("result"), F.col("call_k") == F.col("result_k"), "full")
    pairs = cut(pairs.select(F.coalesce("call_k", "result_k").alias("pair"), F.coalesce("call_conv", "result_conv").alias("conversation"), "call_turn", "result_turn", "call_n", "result_n"), "chat-pairs")

    call_node, result_node = F.concat(F.lit("c"), "pair"), F.concat(F.lit("r"), "pair")
    calls, results = pairs.where("call_n is not null"), pairs.where("result_n is not null")
    nodes = calls.select("conversation", call_node.alias("node"), F.col("call_turn").alias("turn")).unionByName(results.select("conversation", result_node.alias("node"), F.col("result_turn").alias("turn")))
    wants = checked.where("kind = 'call' and k is not null").select(F.col("conv_id").alias("conversation"), "k", F.explode(F.array_distinct("after")).alias("wanted"))
    wants = wants.withColumn("wanted_k", _key(F.col("conversation"), F.col("wanted"))).distinct()
    known = calls.select(F.col("pair").alias("wanted_k"), F.when(F.col("result_n").isNotNull(), result_node).otherwise(call_node).alias("needs"))
    wants = cut(wants.join(known, "wanted_k", "left"), "chat-wants")
    edges = wants.where("needs is not null").select("conversation", F.concat(F.lit("c"), "k").alias("node"), "needs")
    edges = edges.unionByName(results.where("call_n is not null").select("conversation", result_node.alias("node"), call_node.alias("needs")))
    placed = _places(nodes, edges).withColumnRenamed("node", "place_of")
    absent = wants.where("needs is null").groupBy(F.col("k").alias("absent_k")).agg(F.transform(F.collect_set("wanted"), lambda w: F.concat(F.lit("needs an absent call: "), w)).alias("absent"))

    out = checked.join(pairs.select("pair", "call_n", "result_n"), _spread(F.col("k")) == F.col("pair"), "left")
    out = out.join(absent, _spread(F.when(F.col("kind") == "call", F.col("k"))) == F.col("absent_k"), "left")
    node = F.when(F.col("kind") == "call", F.concat(F.lit("c"), "k")).when(F.col("kind") == "result", F.concat(F.lit("r"), "k"))
    out = out.join(placed, _spread(node) == F.col("place_of"), "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    own, other = F.when(is_call, F.col("call_n")).otherwise(F.col("result_n")), F.when(is_call, F.col("result_n")).otherwise(F.col("call_n"))
    say = lambda when, what: F.when(when, F.lit(what))
    linked = F.when(is_call | is_result, other.isNotNull())
    general = F.array_compact(
        F.array(
            say(is_call & other.isNull(), "no result"),
            say(is_result & other.isNull(), "no call"),
            say((is_call | is_result) & (own > 1), "repeated identifier"),
            say(F.col("place_of").isNotNull() & F.col("place").isNull(), "in or behind a cycle"),
        )
    )
    problems = F.array_sort(F.concat(general, "faults", F.when(is_call & F.col("absent").isNotNull(), F.col("absent")).otherwise(F.array().cast("array<string>"))))
    out = out.withColumn("problems", problems).withColumn("place", F.greatest("turn", F.coalesce("place", F.col("turn"))))
    return out.select("conv_id", "turn", "kind", "call_id", linked.alias("linked"), F.when(is_call | is_result, F.size("problems") == 0).alias("valid"), "problems", "place", "json")


def as_calls(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations: a user's turn calls a tool, the assistant's next turn is its result.

    Plain conversations have no calls, so they are made up by rules from the text's length n, faulty ones among them. Tool and
    arguments by n % 6: 1 the turn as text, 2 no turn, 3 also max_words, 4 a field that the schema lacks, 5 a tool that isn't known.
    What a call waits for: the user's next call if n % 4 is 0, else the one before, unless that waits itself and n % 3 isn't 0 (if
    it is, the two make a cycle); and the conversation's first call if n % 5 is 0.
    """
    turn, user, assistant = F.col("turn"), F.col("role") == "user", F.col("role") == "assistant"
    identifier = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    by_role = Window.partitionBy("conv_id", "role").orderBy("turn")
    n = F.coalesce(F.length("text"), F.lit(0))
    known = conversations.select(
        "conv_id", "turn", "role", "text", n.alias("n"),
        F.lag("turn").over(by_role).alias("before"), F.lead("turn").over(by_role).alias("next"), F.first("turn").over(by_role).alias("first"),
        F.lag(n % 4 == 0).over(by_role).alias("waits"),
    )
    kind = F.col("n") % 6
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    prompt = F.when(F.col("text").isNotNull(), F.regexp_extract(F.to_json(F.struct(F.col("text").alias("prompt"))), r"(?s)^\{(.*)\}$", 1))
    number = turn.cast("string")
    fields = F.array(
        F.when(kind == 1, field("turn", F.concat(F.lit('"'), number, F.lit('"')))).when(kind != 2, field("turn", number)),
        prompt,
        F.when(kind == 3, field("max_words", F.col("n").cast("string"))),
        F.when(kind == 4, field("words", F.col("n").cast("string"))),
    )
    ahead = (F.col("n") % 4 == 0) & F.col("next").isNotNull()
    back = F.col("before").isNotNull() & (~F.col("waits") | (F.col("n") % 3 == 0))
    wanted = F.array_compact(F.array(F.when(ahead, identifier(F.col("next"))).when(back, identifier(F.col("before"))), F.when((F.col("n") % 5 == 0) & (F.col("first") < turn), identifier(F.col("first")))))
    return known.select(
        "conv_id",
        "turn",
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        "role",
        F.when(user, identifier(turn)).when(assistant, identifier(turn - 1)).alias("call_id"),
        F.when(user & (kind == 5), "guess").when(user, "answer").alias("name"),
        F.when(user, F.concat(F.lit("{ "), F.array_join(F.array_compact(fields), ", "), F.lit(" }"))).alias("arguments"),
        F.when(user, wanted).alias("after"),
        "text",
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_tool_calls(as_calls(table(spark, sf_dir, "conversations")), literal_rows(spark, ANSWER, ("name", "field", "type", "required")))
    return linked.withColumn("problems", F.array_join("problems", "; "))


QUERIES = {"op4_chat_formatting": op4_chat_formatting}

SQL = {
    "op4_chat_formatting": r"""
WITH RECURSIVE t AS (SELECT *, coalesce(length(text), 0) AS n FROM conversations),
u AS (
  SELECT *, lag(turn) OVER w AS before, lead(turn) OVER w AS next, first(turn) OVER w AS head, lag(n % 4 = 0) OVER w AS waits
  FROM t WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)),
m AS (
  SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN conv_id || '-' || turn WHEN 'assistant' THEN conv_id || '-' || (turn - 1) END AS call_id,
         CASE WHEN role = 'user' AND n % 4 = 0 AND next IS NOT NULL THEN next WHEN role = 'user' AND before IS NOT NULL AND (NOT waits OR n % 3 = 0) THEN before END AS one,
         CASE WHEN role = 'user' AND n % 5 = 0 AND head < turn THEN head END AS two
  FROM u),
l AS (
  SELECT *, CASE WHEN kind <> 'message' THEN EXISTS (
           SELECT 1 FROM m o WHERE o.call_id = m.call_id AND o.conv_id = m.conv_id AND o.kind <> m.kind AND o.kind <> 'message') END AS linked
  FROM m),
-- what a message needs: a result its call (the turn before), a call the results of those it waits for, or those calls if they have none
edges AS (
  SELECT conv_id, turn, turn - 1 AS needs FROM l WHERE kind = 'result' AND linked
  UNION
  SELECT c.conv_id, c.turn, CASE WHEN w.linked THEN w.turn + 1 ELSE w.turn END
  FROM l c JOIN l w ON w.conv_id = c.conv_id AND w.kind = 'call' AND (w.turn = c.one OR w.turn = c.two) WHERE c.kind = 'call'),
sizes AS (SELECT conv_id, count(*) AS size FROM m WHERE kind <> 'message' GROUP BY conv_id),
walks AS (
  SELECT conv_id, turn, turn AS place, 0 AS steps FROM m WHERE kind <> 'message'
  UNION
  SELECT w.conv_id, w.turn, e.needs, w.steps + 1
  FROM walks w JOIN edges e ON e.conv_id = w.conv_id AND e.turn = w.place JOIN sizes s ON s.conv_id = w.conv_id WHERE w.steps <= s.size),
places AS (
  SELECT conv_id, turn, max(steps) > any_value(size) AS cyclic, max(place + steps) AS place FROM walks JOIN sizes USING (conv_id) GROUP BY conv_id, turn),
faults AS (
  SELECT l.*, coalesce(cyclic, false) AS cyclic, CASE WHEN cyclic OR cyclic IS NULL THEN l.turn ELSE place END AS place, list_sort(list_filter([
           CASE WHEN kind = 'call' AND NOT linked THEN 'no result' WHEN kind = 'result' AND NOT linked THEN 'no call' END,
           CASE WHEN cyclic THEN 'in or behind a cycle' END,
           CASE WHEN kind = 'call' AND n % 6 = 5 THEN 'unknown tool' END,
           CASE WHEN kind = 'call' AND n % 6 = 1 THEN 'type: turn' END,
           CASE WHEN kind = 'call' AND n % 6 = 2 THEN 'missing: turn' END,
           CASE WHEN kind = 'call' AND n % 6 <> 5 AND text IS NULL THEN 'missing: prompt' END,
           CASE WHEN kind = 'call' AND n % 6 = 4 THEN 'not in the schema: words' END], lambda x: x IS NOT NULL)) AS problems
  FROM l LEFT JOIN places USING (conv_id, turn))
SELECT conv_id, turn, kind, call_id, linked, CASE WHEN kind <> 'message' THEN len(problems) = 0 END AS valid,
       array_to_string(problems, '; ') AS problems, place,
       CASE kind WHEN 'call' THEN json_object('arguments', CASE n % 6
                        WHEN 1 THEN json_object('prompt', text, 'turn', turn::VARCHAR) WHEN 2 THEN json_object('prompt', text)
                        WHEN 3 THEN json_object('max_words', n, 'prompt', text, 'turn', turn) WHEN 4 THEN json_object('prompt', text, 'turn', turn, 'words', n)
                        ELSE json_object('prompt', text, 'turn', turn) END,
                      'id', call_id, 'name', CASE n % 6 WHEN 5 THEN 'guess' ELSE 'answer' END, 'role', 'assistant', 'type', 'tool_call')
                 WHEN 'result' THEN json_object('content', text, 'id', call_id, 'role', 'tool', 'type', 'tool_result')
                 ELSE json_object('content', text, 'role', role) END::VARCHAR AS json
FROM faults""",
}
