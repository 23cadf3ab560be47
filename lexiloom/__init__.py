"""Corpus and tokenizer analytics on Spark."""

from lexiloom.arguments import TokenizerSettings
from lexiloom.operators.bpe import BpeModel
from lexiloom.operators.masks import Extraction
from lexiloom.operators.modular import ModularTokenizer
from lexiloom.operators.sampling import SamplingConfig, Strategy
from lexiloom.sources.models import load_model

__all__ = ["BpeModel", "Extraction", "ModularTokenizer", "SamplingConfig", "Strategy", "TokenizerSettings", "load_model"]
