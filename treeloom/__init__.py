"""Analytics over containment trees and kinded references, on Spark DataFrames."""
