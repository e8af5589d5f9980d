"""tessera: Spark-native questionnaire annotation, contrastive feature
discovery and subtype analytics over text corpora.

Every operator is a function from DataFrames (plus plain parameters) to a
DataFrame; nothing is collected to the driver except bounded scalars.
"""

__version__ = "0.1.0"
