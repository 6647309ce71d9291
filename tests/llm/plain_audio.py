"""Sample by sample, from the definitions of the codings."""

from paperloom.llm.audio import INDEX_CHANGES, STEPS


def mu_law(code: int) -> int:
    code = ~code & 0xFF
    t = ((code & 0x0F) << 3) + 0x84
    t <<= (code & 0x70) >> 4
    return 0x84 - t if code & 0x80 else t - 0x84


def a_law(code: int) -> int:
    code ^= 0x55
    t, segment = (code & 0x0F) << 4, (code & 0x70) >> 4
    t += 8 if segment == 0 else 0x108
    if segment > 1:
        t <<= segment - 1
    return t if code & 0x80 else -t


def adpcm(block: bytes) -> list[int]:
    value = int.from_bytes(block[:2], "little", signed=True)
    index = min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(STEPS[index])
            change = step >> 3
            change += step if code & 4 else 0
            change += step >> 1 if code & 2 else 0
            change += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(INDEX_CHANGES[code])))
            out.append(value)
    return out


def doubled(samples: list[int]) -> list[int]:
    out, last = [], len(samples) - 1
    at = lambda i: int(samples[max(0, min(last, i))])
    for i in range(len(samples)):
        out += [at(i), max(-32768, min(32767, (9 * (at(i) + at(i + 1)) - at(i - 1) - at(i + 2) + 8) >> 4))]
    return out


def halved(samples: list[int]) -> list[int]:
    at = lambda i: int(samples[max(0, min(len(samples) - 1, i))])
    return [(at(i - 1) + 2 * at(i) + at(i + 1) + 2) >> 2 for i in range(0, len(samples), 2)]
