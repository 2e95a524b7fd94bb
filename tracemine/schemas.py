"""The data model: trace log, entity tables, and fixed values of the domain."""

from __future__ import annotations

_LABELS = "STRUCT<ptr: STRING, label: ARRAY<STRING>>"
_BYTES = f"ARRAY<STRUCT<offset: INT, ptr: STRING, tcn: INT, uniqueLabelSet: {_LABELS}>>"
_CALL = "STRUCT<fileCallee: STRING, functionNameCallee: STRING>"

#: The kinds of log entries: the struct that is set.
KINDS = ("taintQueryPri", "taintedBranch", "attackPoint", "dwarf2Call", "dwarf2Ret", "sourceTraceId", "fileTaintMatch")

#: One entry of a trace log; exactly one of the structs is set.
PLOG = (
    "instr STRING, "
    "taintQueryPri STRUCT<len: BIGINT, numTainted: BIGINT, srcInfo: STRUCT<filename: STRING, linenum: BIGINT, astnodename: STRING, astLocId: BIGINT, insertionpoint: BIGINT>, "
    f"taintQuery: {_BYTES}>, "
    f"taintedBranch STRUCT<taintQuery: {_BYTES}>, "
    "attackPoint STRUCT<info: INT, srcInfo: STRUCT<filename: STRING, astLocId: BIGINT>>, "
    f"dwarf2Call {_CALL}, dwarf2Ret {_CALL}, "
    "sourceTraceId STRUCT<astLocId: BIGINT>, "
    "fileTaintMatch STRUCT<filename: STRING>"
)

_LOC = "loc_filename STRING, loc_begin_line INT, loc_begin_column INT, loc_end_line INT, loc_end_column INT"

#: Entity tables: columns by table.
ENTITIES = {
    "source_lval": f"lval_key BIGINT, {_LOC}, ast_name STRING, len_bytes INT",
    "label_set": "ptr BIGINT, inputfile STRING, labels ARRAY<INT>, first_seq BIGINT",
    "dua": "dua_key BIGINT, lval_key BIGINT, inputfile STRING, instr BIGINT, seq BIGINT, fake_dua BOOLEAN, byte_ptr ARRAY<BIGINT>, byte_tcn ARRAY<INT>, all_labels ARRAY<INT>, max_tcn INT, max_cardinality INT, trace_index BIGINT",
    "dua_viable_byte": "dua_key BIGINT, offset INT, ptr BIGINT",
    "dua_bytes": "dua_bytes_key BIGINT, dua_key BIGINT, low INT, high INT, all_labels ARRAY<INT>",
    "attack_point": f"atp_key BIGINT, {_LOC}, type INT, calltrace ARRAY<BIGINT>, stack_offset BIGINT, trace_index BIGINT",
    "atp_execution": "atp_key BIGINT, inputfile STRING, instr BIGINT",
    "liveness_snapshot": "inputfile STRING, label INT, death_instr BIGINT",
    "call_trace": "caller STRING, file STRING",
    "source_trace": f"index BIGINT, {_LOC}",
    "source_function": f"name STRING, {_LOC}",
    "call": "call_instr BIGINT, ret_instr BIGINT, function STRING, file STRING, depth BIGINT",
    "bug": "bug_key BIGINT, type INT, trigger BIGINT, trigger_lval BIGINT, atp_key BIGINT, max_liveness BIGINT, magic BIGINT, extra_duas ARRAY<BIGINT>, stackoff BIGINT",
    "build": "id BIGINT, compile BOOLEAN, output STRING",
    "build_bug": "build BIGINT, idx INT, bug BIGINT",
    "run": "id BIGINT, build BIGINT, fuzzed BIGINT, exitcode INT, output STRING, success BOOLEAN, validated BOOLEAN",
}

#: Bytes of a trigger; the pointer of untainted bytes; where no input file is known.
MAGIC, UNTAINTED, UNKNOWN_FILE = 4, 777, "UNKNOWN_FILE"
#: Kinds of attack points and of bugs, by code.
ATP_KINDS = {"FUNCTION_ARG": 0, "POINTER_READ": 1, "POINTER_WRITE": 2, "QUERY_POINT": 3, "PRINTF_LEAK": 4, "MALLOC_OFF_BY_ONE": 5}
BUG_KINDS = {"PTR_ADD": 0, "RET_BUFFER": 1, "REL_WRITE": 2, "PRINTF_LEAK": 3, "MALLOC_OFF_BY_ONE": 4, "CHAFF_STACK_UNUSED": 5, "CHAFF_STACK_CONST": 6, "CHAFF_HEAP_CONST": 7, "CHAFF_DIVZERO": 8}
#: By code of a bug's kind, how many extra DUAs it has, and how many bytes of padding it needs (if any).
EXTRA_DUAS = {0: 0, 1: 1, 2: 2, 3: 0, 4: 0, 5: 0, 6: 1, 7: 1, 8: 1}
PADS = {0: 0, 1: 20, 2: 8, 3: 0, 4: 0}
#: Kinds of bugs that a kind of attack point can have.
KINDS_OF_ATP = {0: [0], 1: [0], 2: [0, 2], 3: [1, 6, 7, 8], 4: [3], 5: [4]}
