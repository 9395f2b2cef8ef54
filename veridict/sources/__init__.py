"""Readers of evaluation trees and adapters of the driver's tables."""
