import os
from pathlib import Path

# Python workers import the package by this path.
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).parents[2]), os.environ.get("PYTHONPATH", "")])
