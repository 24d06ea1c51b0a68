"""steadfold: keep a deployed risk model trustworthy, on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame.  Nothing is executed
until the caller acts, except where a fitted parameter (an imputation mean, a
model, the decision of one maintenance round) has to come back to the driver.
"""

__version__ = "0.1.0"
