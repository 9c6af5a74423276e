"""Bytecode transforms: assembler, disassembler, machine, and a compiler to columns."""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import signed
from ..functions.columns import wrap_i64

# Opcode, mnemonic, kind of operand.
OPCODES = [
    (0x00, "nop", ""),
    (0x01, "push", "byte"),
    (0x02, "pushw", "word"),
    (0x03, "add", ""),
    (0x04, "sub", ""),
    (0x05, "mul", ""),
    (0x06, "dup", ""),
    (0x07, "drop", ""),
    (0x08, "load", "register"),
    (0x09, "store", "register"),
    (0x0A, "jz", "jump"),
    (0x0B, "ret", ""),
]
BY_NAME = {name: (code, kind) for code, name, kind in OPCODES}
BY_CODE = {code: (name, kind) for code, name, kind in OPCODES}
SIZES = {"": 0, "byte": 1, "word": 2, "register": 1, "jump": 1}
MAX_STACK, REGISTERS, MAX_STEPS = 256, 16, 65_536


class TransformError(ValueError):
    """Source that doesn't assemble, or a program that goes wrong."""


def _number(text: str, line: int) -> int:
    try:
        return int(text, 16) if text.startswith("0x") else int(text)
    except ValueError as e:
        raise TransformError(f"line {line}: bad operand {text!r}") from e


def assemble(source: str) -> bytes:
    """``mnemonic [operand]`` lines, ``label:`` lines, ``;`` comments; jumps are relative to their end."""
    labels: dict[str, int] = {}
    program = []
    at = 0
    for n, raw in enumerate(source.splitlines(), 1):
        line = raw.partition(";")[0].strip()
        if not line:
            continue
        if line.endswith(":"):
            if (name := line[:-1].strip()) in labels:
                raise TransformError(f"line {n}: duplicate label {name}")
            labels[name] = at
            continue
        name, *operands = line.split()
        if name.lower() not in BY_NAME:
            raise TransformError(f"line {n}: no instruction {name!r}")
        code, kind = BY_NAME[name.lower()]
        if kind and not operands:
            raise TransformError(f"line {n}: {name} needs an operand")
        at += 1 + SIZES[kind]
        program.append((n, code, kind, operands[0] if kind else None, at))
    out = bytearray()
    for n, code, kind, operand, end in program:
        out.append(code)
        if kind == "jump":
            if operand not in labels:
                raise TransformError(f"line {n}: no label {operand!r}")
            distance = labels[operand] - end
            if not -128 <= distance <= 127:
                raise TransformError(f"line {n}: jump too far")
            out += struct.pack(">b", distance)
        elif kind:
            value = _number(operand, n)
            if kind == "register" and not 0 <= value < REGISTERS:
                raise TransformError(f"line {n}: no register {value}")
            out += (value % (1 << 8 * SIZES[kind])).to_bytes(SIZES[kind], "big")
    return bytes(out)


def disassemble(code: bytes) -> list[str]:
    out, at = [], 0
    while at < len(code):
        start = at
        name, kind = BY_CODE.get(code[at], (f".byte 0x{code[at]:02x}", ""))
        at += 1
        raw = code[at : at + SIZES[kind]]
        if len(raw) < SIZES[kind]:
            text = "<truncated operand>"
        else:
            at += SIZES[kind]
            text = f"{name} {int.from_bytes(raw, 'big', signed=kind == 'jump')}" if kind else name
        out.append(f"{start:04x}: {text}")
    return out


class Step(NamedTuple):
    step: int
    pc: int
    opcode: int
    depth: int
    top: int


def execute(code: bytes, inputs: dict[int, int] | None = None) -> Iterator[Step]:
    """Runs to the end, yielding the state after every instruction; the result is the last top."""
    stack: list[int] = []
    registers = [0] * REGISTERS
    for r, v in (inputs or {}).items():
        if r < REGISTERS:
            registers[r] = signed(v & (1 << 64) - 1)
    at = steps = 0

    def need(n: int) -> None:
        if len(stack) < n:
            raise TransformError("stack underflow")

    while at < len(code):
        steps += 1
        if steps > MAX_STEPS:
            raise TransformError("step budget exhausted")
        pc, op = at, code[at]
        if op not in BY_CODE:
            raise TransformError(f"bad opcode {op}")
        name, kind = BY_CODE[op]
        raw = code[at + 1 : at + 1 + SIZES[kind]]
        if len(raw) < SIZES[kind]:
            raise TransformError(f"{name} without its operand")
        at += 1 + len(raw)
        value = int.from_bytes(raw, "big", signed=kind == "jump")
        if kind == "register" and value >= REGISTERS:
            raise TransformError("register out of range")
        if name in ("push", "pushw"):
            stack.append(value)
        elif name == "load":
            stack.append(registers[value])
        elif name == "dup":
            need(1)
            stack.append(stack[-1])
        elif name in ("add", "sub", "mul"):
            need(2)
            b, a = stack.pop(), stack.pop()
            stack.append(signed((a + b if name == "add" else a - b if name == "sub" else a * b) & (1 << 64) - 1))
        elif name in ("drop", "store", "jz"):
            need(1)
            top = stack.pop()
            if name == "store":
                registers[value] = top
            elif name == "jz" and top == 0:
                at += value
                if not 0 <= at <= len(code):
                    raise TransformError("jump out of range")
        if len(stack) > MAX_STACK:
            raise TransformError("stack overflow")
        yield Step(steps, pc, op, len(stack), stack[-1] if stack else 0)
        if name == "ret":
            break


def run(code: bytes, inputs: dict[int, int] | None = None) -> int:
    last = deque(execute(code, inputs), maxlen=1)
    return last[0].top if last else 0


def trace(code: bytes, inputs: dict[int, int] | None = None, capacity: int = 64) -> tuple[list[Step], int]:
    """The last ``capacity`` steps and how many went before."""
    steps = list(execute(code, inputs))
    return steps[-capacity:], max(0, len(steps) - capacity)


def render_trace(steps: list[Step]) -> str:
    return "".join(f"#{s.step:<6} pc={s.pc:<5} op=0x{s.opcode:02x} depth={s.depth:<3} top={s.top}\n" for s in steps)


def to_column(code: bytes, inputs: dict[int, Column]) -> Column | None:
    """A native expression of a program without jumps; None if it has any. Errors raise here.

    A null input reads as 0, as a register without an input does.
    """
    stack: list[Column] = []
    zero = F.lit(0).cast("long")
    registers = {r: F.coalesce(c.cast("long"), zero) for r, c in inputs.items()}
    at = 0
    while at < len(code):
        name, kind = BY_CODE.get(code[at], ("", ""))
        raw = code[at + 1 : at + 1 + SIZES[kind]]
        if not name or len(raw) < SIZES[kind]:
            raise TransformError("bad instruction")
        value = int.from_bytes(raw, "big")
        at += 1 + len(raw)
        if kind == "register" and value >= REGISTERS:
            raise TransformError("register out of range")
        if name == "jz":
            return None
        if name == "ret":
            break
        if len(stack) < {"add": 2, "sub": 2, "mul": 2, "dup": 1, "drop": 1, "store": 1}.get(name, 0):
            raise TransformError("stack underflow")
        if name in ("push", "pushw"):
            stack.append(F.lit(value).cast("long"))
        elif name == "load":
            stack.append(registers.get(value, zero))
        elif name == "dup":
            stack.append(stack[-1])
        elif name == "drop":
            stack.pop()
        elif name == "store":
            registers[value] = stack.pop()
        elif name in ("add", "sub", "mul"):
            b, a = (stack.pop().cast("decimal(19,0)") for _ in range(2))
            stack.append(wrap_i64(a + b if name == "add" else a - b if name == "sub" else a * b))
    return stack[-1] if stack else zero


def transform(df: DataFrame, code: bytes, inputs: dict[int, str], output: str = "result") -> DataFrame:
    """``df`` with the program's result: native where it has no jumps, else by Arrow batches.

    A program that goes wrong on a row gives null there; a null input reads as 0 on either way.
    """
    native = to_column(code, {r: F.col(c) for r, c in inputs.items()})
    if native is not None:
        return df.withColumn(output, native)
    order = list(inputs)

    @F.pandas_udf("long")
    def machine(frame: pd.DataFrame) -> pd.Series:
        def one(values):
            try:
                return run(code, dict(zip(order, map(int, values), strict=True)))
            except TransformError:
                return None

        return pd.Series([one(v) for v in frame.itertuples(index=False)], dtype="object")

    return df.withColumn(output, machine(F.struct(*[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in inputs.values()])))


class Modules:
    """Loaded programs by number, and symbols: parts of them by offset and length."""

    def __init__(self) -> None:
        self.code: dict[int, bytes] = {}
        self.symbols: dict[int, tuple[int, int, int]] = {}
        self.loads = self.reloads = 0

    def load(self, number: int, code: bytes) -> None:
        self.reloads += number in self.code
        self.loads += number not in self.code
        self.code[number] = code

    def reload(self, number: int, code: bytes) -> None:
        if number not in self.code:
            raise TransformError("reload of a module that isn't loaded")
        self.load(number, code)

    def unload(self, number: int) -> bool:
        return self.code.pop(number, None) is not None

    def define(self, symbol: int, module: int, offset: int, length: int) -> None:
        self.symbols[symbol] = (module, offset, length)

    def forget(self, symbol: int) -> bool:
        return self.symbols.pop(symbol, None) is not None

    def call(self, symbol: int, value: int = 0) -> int:
        """Undefined symbols name a module (high half) and an offset in it (low half)."""
        if symbol not in self.symbols and symbol >> 16 in self.code:
            offset = symbol & 0xFFFF
            self.define(symbol, symbol >> 16, offset, max(0, len(self.code[symbol >> 16]) - offset))
        if symbol not in self.symbols:
            raise TransformError("no such symbol")
        module, offset, length = self.symbols[symbol]
        if module not in self.code:
            raise TransformError("the symbol's module is gone")
        if offset + length > len(self.code[module]):
            raise TransformError("symbol past its module")
        return run(self.code[module][offset : offset + length], {0: value})


class TraceProgram:
    """A table function of a program and its first register: one row for each step that it takes."""

    def eval(self, code: bytes, value: int):
        try:
            yield from (tuple(s) for s in execute(bytes(code), {0: value}))
        except TransformError:
            return


def register_trace(spark) -> None:
    """``SELECT * FROM transform_trace(X'...', 7)``."""
    spark.udtf.register("transform_trace", F.udtf(TraceProgram, returnType="step int, pc int, opcode int, depth int, top bigint"))
