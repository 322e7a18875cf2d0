import numpy as np

from tessera.operators.compiled import CompiledDictionary
from tessera.operators.kernel import Segmenter
from tessera.sources.resources import Matrix
from tessera.types import Language


def segmenter(entries, language=Language.JAPANESE, matrix=None, **more) -> Segmenter:
    cells = None if matrix is None else Matrix(np.array(matrix, np.int16), int(np.array(matrix).size))
    return Segmenter(CompiledDictionary.of_entries(language, entries, matrix=cells, **more))


def surfaces(tokens) -> list[str]:
    return [t.surface for t in tokens]
